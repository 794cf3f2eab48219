"""News articles: flattening, cleaning, validation, priorities, storage reads and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merge
from .validate import issues

# Every character that counts as white space, spelled out so that all engines agree.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
AGENCY = r"(?i)\(Reuters\)|\(AP\)|\(Bloomberg\)"

# Well-known tickers, in order of priority.
MAJOR = (
    "AAPL", "GOOGL", "MSFT", "AMZN", "TSLA", "META", "NVDA", "NFLX", "SPY", "QQQ", "IWM", "DIA", "VTI", "VOO", "VEA",
    "VWO", "JPM", "BAC", "WFC", "GS", "MS", "C", "BRK.B", "V", "MA", "JNJ", "PFE", "UNH", "ABBV", "MRK", "TMO", "DHR",
    "ABT", "XOM", "CVX", "COP", "SLB", "EOG", "PXD", "KMI", "OKE",
)
VALUE = (
    "BRK.B", "JPM", "BAC", "WFC", "XOM", "CVX", "JNJ", "PG", "KO", "PEP", "WMT", "HD", "VZ", "T", "IBM", "INTC",
)
FUNDS = (
    "SPY", "QQQ", "IWM", "DIA", "VTI", "VOO", "VEA", "VWO", "XLF", "XLK", "XLE",
)


def flatten(raw: DataFrame) -> DataFrame:
    """Vendor article to one flat row; sentiment comes from the first insight that has one."""
    first = F.try_element_at(F.filter("insights", lambda i: F.coalesce(F.length(i["sentiment"]), F.lit(0)) > 0), F.lit(1))
    have = set(raw.columns)

    def text(c, default=None):
        if c not in have:
            return F.lit(default).cast("string").alias(c)
        return (F.coalesce(c, F.lit(default)) if default is not None else F.col(c)).alias(c)

    publisher = {f.name for f in raw.schema["publisher"].dataType.fields}

    def pub(c):
        return (F.col(f"publisher.{c}") if c in publisher else F.lit(None).cast("string")).alias(f"publisher_{c}")

    return raw.select(
        F.col("id").alias("polygon_id"), text("title", ""), text("description", ""), text("article_url", ""),
        text("amp_url"), text("image_url"), text("author", ""), "published_utc", "keywords",
        F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"),
        F.coalesce(F.col("publisher.name"), F.lit("")).alias("publisher_name"), pub("homepage_url"), pub("logo_url"), pub("favicon_url"),
        first["sentiment"].alias("sentiment"), first["sentiment_reasoning"].alias("sentiment_reasoning"), "insights",
    )


def clean_text(c: Column | str) -> Column:
    """Outer space stripped, inner runs collapsed to one blank, agency tags removed."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    stripped = F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, f"{SPACE}+", " "), AGENCY, "")


def normal_insights(c: str = "insights") -> Column:
    return F.transform(c, lambda i: F.struct(
        i["sentiment"].alias("sentiment"), i["sentiment_reasoning"].alias("sentiment_reasoning"),
        F.lit("sentiment").alias("insight_type"), i["sentiment"].alias("insight_value"),
        F.lit(None).cast("double").alias("confidence_score"),
    ))


def process(flat: DataFrame) -> DataFrame:
    return flat.withColumns({c: clean_text(c) for c in ("title", "description", "author")} | {"insights": normal_insights()})


def keyword_list(c: Column | str) -> Column:
    """Text keywords as a list: a JSON list, a bracketed comma list, one JSON value, or null."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.filter(
        F.transform(F.split(F.regexp_replace(F.trim(c), r"^\[+|\]+$", ""), ","), lambda k: F.trim(k)), lambda k: k != ""
    )
    parsed = F.when(c.rlike(r'^\s*\[\s*("|\])'), F.from_json(c, "array<string>"))
    scalar = F.when(c.rlike(r'^\s*(".*"|-?\d+(\.\d+)?|true|false)\s*$'), F.array(F.regexp_replace(F.trim(c), '^"|"$', "")))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, scalar, parts))


def published(c: str = "published_utc") -> Column:
    """ISO time with Z or an offset; null when it is neither."""
    return F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.col(c)))


def required_present(names=("id", "title", "article_url", "published_utc")) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.length(n), F.lit(0)) > 0 for n in names])


def quality(articles: DataFrame, now) -> DataFrame:
    """Adds issues, quality_score and is_valid; now is a parameter so that results repeat."""
    def empty(n):
        return F.coalesce(F.length(n), F.lit(0)) == 0

    required = ("polygon_id", "title", "article_url", "published_utc")
    at, now = published(), F.lit(now).cast("timestamp")
    n = F.length("title")
    rules = [
        *[(empty(c), f"missing_{c}", 0.3) for c in required],
        (n.between(1, 9), "title_too_short", 0.2), (n > 1000, "title_too_long", 0.1),
        (F.coalesce(F.size("tickers"), F.lit(0)) <= 0, "no_tickers", 0.2),
        (at < now - F.expr("INTERVAL 730 DAYS"), "too_old", 0.1), (at > now, "in_future", 0.2),
        (~empty("published_utc") & at.isNull(), "invalid_date", 0.2),
    ]
    score = F.lit(1.0)
    for cond, _, cost in rules:
        score = score - F.when(cond, cost).otherwise(0.0)
    complete = reduce(lambda a, b: a & b, [~empty(c) for c in required])
    return articles.withColumns({
        "issues": issues(*[(c, name) for c, name, _ in rules]), "quality_score": F.greatest(F.lit(0.0), score),
    }).withColumn("is_valid", (F.col("quality_score") > 0.5) & complete)


def newest_distinct(copies: DataFrame, start=None, end=None, limit: int | None = None, key: str = "id") -> DataFrame:
    """One row per id across tickers, within the exact range, newest first."""
    at = published()
    rows = copies.where(F.coalesce(F.length(key), F.lit(0)) > 0)
    if start is not None:
        rows = rows.where(at >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(at <= F.lit(end).cast("timestamp"))
    values = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min_by(F.struct(*values), F.struct("published_utc", "ticker")).alias("r")).select(key, "r.*")
    out = one.orderBy(F.desc("published_utc"), key)
    return out.limit(limit) if limit else out


def per_ticker_limit(copies: DataFrame, k: int) -> DataFrame:
    """Newest k articles per ticker; the limit also applies before the shuffle, so a ticker
    with a large share of the news sends at most k rows per task."""
    w = Window.partitionBy("ticker").orderBy(F.desc("published_utc"), "id")
    return copies.withColumn("rank_in_ticker", F.row_number().over(w)).where(F.col("rank_in_ticker") <= k)


def of_ticker(articles: DataFrame, ticker: str, start=None, end=None, limit=None, at: str = "published_at") -> DataFrame:
    out = articles.where(F.array_contains("tickers", ticker.upper()))
    if start is not None:
        out = out.where(F.col(at) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col(at) <= F.lit(end).cast("timestamp"))
    out = out.orderBy(F.desc(at), "polygon_id")
    return out.limit(limit) if limit else out


def retained(articles: DataFrame, now, days: int = 3 * 365, at: str = "published_at") -> DataFrame:
    """The articles that stay after the retention rule (written as a new version)."""
    return articles.where(F.coalesce(F.col(at) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)), F.lit(True)))


def ticker_rows(articles: DataFrame) -> DataFrame:
    return articles.select("polygon_id", "published_at", F.explode("tickers").alias("ticker"))


def insight_rows(articles: DataFrame) -> DataFrame:
    return articles.select("polygon_id", F.explode("insights").alias("i")).select("polygon_id", "i.*")


# Priorities ---------------------------------------------------------------------------


def is_fund(t: Column) -> Column:
    """Known funds, and by rule every symbol of at most three letters."""
    return t.isin(*FUNDS) | (F.length(t) <= 3)


def _ladder(x: Column, steps, rest: float) -> Column:
    out = F.lit(rest)
    for limit, points in reversed(steps):
        out = F.when(x >= limit, float(points)).otherwise(out)
    return F.when(x.isNotNull() & (x != 0), out).otherwise(0.0)


def priority_score(cap: Column, vol: Column) -> Column:
    return _ladder(cap, [(500e9, 40), (100e9, 35), (50e9, 30), (10e9, 25), (1e9, 15)], 5.0) + _ladder(
        vol, [(50e6, 30), (20e6, 25), (10e6, 20), (5e6, 15), (1e6, 10)], 5.0)


def prioritised(tickers: DataFrame, n: int = 100, include_funds: bool = True) -> DataFrame:
    """Top n active tickers by score, with category and relevance."""
    t, cap = F.col("ticker"), F.col("market_cap")
    rows = tickers.where("active")
    if not include_funds:
        rows = rows.where(~is_fund(t))
    category = (
        F.when(t.isin(*MAJOR), "major").when(t.isin(*VALUE), "value").when(is_fund(t), "etf")
        .when(cap >= 100e9, "large_cap").when(cap >= 10e9, "mid_cap").otherwise("small_cap")
    )
    scored = rows.select(
        "ticker", priority_score(cap, F.col("avg_volume")).alias("priority_score"), "market_cap", "avg_volume",
        t.isin(*MAJOR).alias("is_major"), category.alias("category"),
    ).withColumn("relevance_score", F.col("priority_score") / 100)
    return scored.orderBy(F.desc("priority_score"), "ticker").limit(n)


def fallback_tickers(spark, n: int = 100, include_funds: bool = True) -> DataFrame:
    """Majors in order, then value tickers, when no ticker table is at hand."""
    rows = [(t, 100.0 - i, "Unknown", True, "major") for i, t in enumerate(MAJOR) if include_funds or not (t in FUNDS or len(t) <= 3)]
    have = {r[0] for r in rows}
    rows += [(t, 25.0 - i, "Financial", False, "value") for i, t in enumerate(VALUE) if t not in have]
    return spark.createDataFrame(rows[:n], "ticker string, priority_score double, sector string, is_major boolean, category string")


def lookup(wanted: DataFrame, priorities: DataFrame) -> DataFrame:
    """Priority record per wanted ticker; a default record when it is not listed."""
    out = wanted.select(F.upper("ticker").alias("ticker")).join(priorities, "ticker", "left")
    return out.withColumns({
        "priority_score": F.coalesce("priority_score", F.lit(0.0)), "category": F.coalesce("category", F.lit("unknown")),
        "is_major": F.coalesce("is_major", F.col("ticker").isin(*MAJOR)),
    })


def empty_windows(tickers: DataFrame, articles: DataFrame, start, end, days: int = 30) -> DataFrame:
    """Backfill windows per ticker that hold no article yet (both ends belong to a window).

    Articles are reduced to their window numbers before the anti join.
    """
    s, e = (F.lit(x).cast("timestamp") for x in (start, end))
    size = days * 86400
    s0, e0 = F.unix_timestamp(s), F.unix_timestamp(e)
    numbers = F.sequence(F.lit(0).cast("long"), F.ceil((e0 - s0) / size).cast("long") - 1)
    windows = tickers.select("ticker", F.explode(numbers).alias("w")).select(
        "ticker", "w", F.timestamp_seconds(s0 + F.col("w") * size).alias("window_start"),
        F.timestamp_seconds(F.least(s0 + (F.col("w") + 1) * size, e0)).alias("window_end"),
    )
    t = F.unix_timestamp("published_at") - s0
    at = F.floor(t / size)
    hit = F.when(t % size == 0, F.array(at, at - 1)).otherwise(F.array(at))
    filled = (
        ticker_rows(articles).where(F.col("published_at").between(s, e)).select("ticker", F.explode(hit).alias("w")).distinct()
    )
    return windows.join(filled, ["ticker", "w"], "left_anti").drop("w")


# Batches and statistics ---------------------------------------------------------------


def prepare_batch(raw: DataFrame, now, relevance: float = 0.5) -> DataFrame:
    """flatten, clean, keywords, validate, score: one row per article with is_valid."""
    p = process(flatten(raw))
    if dict(p.dtypes)["keywords"] == "string":
        p = p.withColumn("keywords", keyword_list("keywords"))
    return quality(p, now).withColumn("relevance_score", F.lit(relevance))


STORED = (
    "polygon_id", "title", "description", "article_url", "author", "published_at", "publisher_name", "keywords",
    "quality_score", "relevance_score", "tickers", "insights",
)


def storable(prepared: DataFrame) -> DataFrame:
    """Valid articles with a publication time, in the store's columns."""
    return prepared.where("is_valid").withColumn("published_at", published()).where(F.col("published_at").isNotNull()).select(*STORED)


def store_batch(stored: DataFrame, prepared: DataFrame) -> DataFrame:
    """Valid articles merged into the store; outcome per article (see merge.upsert_articles)."""
    return merge.upsert_articles(stored.select(*STORED), storable(prepared))


def batch_counts(prepared: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: fetched, stored, updated, skipped (invalid ones included)."""
    fetched = prepared.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(~F.col("is_valid")).alias("invalid"))
    o = F.col("outcome")
    done = merged.agg(F.count_if(o == "new").alias("n"), F.count_if(o == "updated").alias("u"), F.count_if(o == "skipped").alias("s"))
    s = done.agg(F.struct(F.first("n").alias("n"), F.first("u").alias("u"), F.first("s").alias("s"))).scalar()
    return fetched.select(
        "fetched", s.getField("n").alias("stored"), s.getField("u").alias("updated"), (F.col("invalid") + s.getField("s")).alias("skipped")
    )


def statistics(articles: DataFrame, start=None, end=None) -> DataFrame:
    """(section, key, articles) over the range: total, ticker, sentiment, publisher."""
    rows = articles
    if start is not None:
        rows = rows.where(F.col("published_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("published_at") <= F.lit(end).cast("timestamp"))

    def section(df, name, key):
        return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("articles")).select(F.lit(name).alias("section"), "key", "articles")

    return reduce(DataFrame.unionByName, [
        rows.agg(F.count(F.lit(1)).alias("articles")).select(F.lit("total").alias("section"), F.lit("all").alias("key"), "articles"),
        section(ticker_rows(rows), "ticker", F.col("ticker")),
        section(insight_rows(rows).where(F.col("sentiment").isNotNull()), "sentiment", F.col("sentiment")),
        section(rows, "publisher", F.col("publisher_name")),
    ])


def latest_dates(articles: DataFrame, now, days: int = 7) -> DataFrame:
    """Newest article per ticker and how many fall in the last days."""
    recent = F.col("published_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return ticker_rows(articles).groupBy("ticker").agg(
        F.max("published_at").alias("latest"), F.count_if(recent).alias("recent_articles")
    )


def latest_overall(articles: DataFrame) -> DataFrame:
    return articles.agg(F.max("published_at").alias("latest"))
