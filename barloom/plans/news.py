"""Queries: news articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, news
from ..sources import views
from .common import near, query, rounded, shown
from .views import sql

NOW = "2024-01-20"
SP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def cleaned(e):
    return f"regexp_replace(regexp_replace(regexp_replace(coalesce({e}, ''), '^{SP}+|{SP}+$', '', 'g'), '{SP}+', ' ', 'g'), '\\(Reuters\\)|\\(AP\\)|\\(Bloomberg\\)', '', 'gi')"


# Vendor articles with the damages the rules look for, by article number.
DAMAGED = """SELECT id, doc_id AS k, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 29 = 0 THEN 'Short' WHEN doc_id % 3 = 0 THEN '(reuters)  ' || title ELSE title END AS title,
  description, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE article_url END AS article_url, author, publisher_name, lang,
  CASE WHEN doc_id % 23 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'not a date' WHEN doc_id % 17 = 0 THEN strftime(published_at - INTERVAL 3 YEAR, '%Y-%m-%dT%H:%M:%SZ')
    ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') END AS published_utc,
  CASE WHEN doc_id % 11 = 0 THEN [] ELSE tickers END AS tickers, i.sentiment
FROM articles LEFT JOIN (SELECT article_id, max(sentiment) AS sentiment FROM insights GROUP BY 1) i ON i.article_id = articles.id"""
TIMED = "SELECT *, TRY_CAST(replace(replace(published_utc, 'T', ' '), 'Z', '') AS TIMESTAMP) AS pub FROM damaged"
A = ("articles", "insights")


def raw(spark, folder):
    """One insight per labelled article, behind one without a sentiment."""
    k = F.col("doc_id")
    a = views.articles(spark, folder)
    best = views.insights(spark, folder).groupBy("article_id").agg(F.max("sentiment").alias("s"))
    a = a.join(best, a.id == best.article_id, "left")

    def insight(s, why):
        return F.struct(F.element_at("tickers", 1).alias("ticker"), s.alias("sentiment"), F.lit(why).alias("sentiment_reasoning"))

    at = F.col("published_utc")
    old = F.date_format(F.add_months(F.try_to_timestamp(at), -36), "yyyy-MM-dd")
    return a.select(
        "id", F.when(k % 13 == 0, "").when(k % 29 == 0, "Short").when(k % 3 == 0, F.concat(F.lit("(reuters)  "), "title")).otherwise(F.col("title")).alias("title"),
        "description", F.when(k % 31 != 0, F.col("article_url")).alias("article_url"), "author", "publisher",
        F.when(k % 23 == 0, "").when(k % 19 == 0, "not a date").when(k % 17 == 0, F.concat(old, F.substring(at, 11, 20))).otherwise(at).alias("published_utc"),
        "keywords", F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("tickers")).alias("tickers"),
        F.when(F.col("s").isNotNull(), F.array(insight(F.lit(None).cast("string"), "none"), insight(F.col("s"), "label")))
        .otherwise(F.array().cast("array<struct<ticker:string,sentiment:string,sentiment_reasoning:string>>")).alias("insights"),
        k.alias("doc_id"),
    )


@query("b1_flatten_articles", sql("""SELECT id AS polygon_id, title, coalesce(article_url, '') AS article_url, publisher_name, 'https://' || publisher_name AS publisher_homepage_url,
  published_utc, array_to_string(list_sort(tickers), ',') AS tickers, sentiment, CASE WHEN sentiment IS NOT NULL THEN 'label' END AS sentiment_reasoning FROM damaged""", *A, damaged=DAMAGED))
def b1(spark, folder):
    return news.flatten(raw(spark, folder)).select(
        "polygon_id", "title", "article_url", "publisher_name", "publisher_homepage_url", "published_utc",
        F.array_join(F.array_sort("tickers"), ",").alias("tickers"), "sentiment", "sentiment_reasoning")


@query("b2_clean_text", f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents")
def b2(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", news.clean_text("text").alias("cleaned"))


@query("b3_insights", sql("SELECT id AS polygon_id, sentiment, 'sentiment' AS insight_type, sentiment AS insight_value FROM damaged WHERE sentiment IS NOT NULL", *A, damaged=DAMAGED))
def b3(spark, folder):
    p = news.process(news.flatten(raw(spark, folder)))
    return news.insight_rows(p).where(F.col("sentiment").isNotNull()).select("polygon_id", "sentiment", "insight_type", "insight_value")


RULES = [
    ("id IS NULL", "missing_polygon_id", 0.3), ("title = ''", "missing_title", 0.3), ("article_url IS NULL", "missing_article_url", 0.3),
    ("published_utc = ''", "missing_published_utc", 0.3), ("length(title) BETWEEN 1 AND 9", "title_too_short", 0.2), ("length(title) > 1000", "title_too_long", 0.1),
    ("len(tickers) = 0", "no_tickers", 0.2), (f"pub < TIMESTAMP '{NOW}' - INTERVAL 730 DAY", "too_old", 0.1), (f"pub > TIMESTAMP '{NOW}'", "in_future", 0.2),
    ("published_utc <> '' AND pub IS NULL", "invalid_date", 0.2),
]
SCORE = "1.0::DOUBLE" + "".join(f" - CASE WHEN {c} THEN {x}::DOUBLE ELSE 0 END" for c, _, x in RULES)
PREPARED = f"SELECT *, concat_ws(';', {', '.join(f'''CASE WHEN {c} THEN '{n}' END''' for c, n, _ in RULES)}) AS issues, greatest(0, {SCORE}) AS quality_score, " \
    f"(greatest(0, {SCORE}) > 0.5 AND title <> '' AND article_url IS NOT NULL AND published_utc <> '') AS is_valid FROM " \
    f"(SELECT * REPLACE ({cleaned('title')} AS title, {cleaned('description')} AS description, {cleaned('author')} AS author) FROM timed)"
P = {"damaged": DAMAGED, "timed": TIMED, "prepared": PREPARED}


def prepared(spark, folder):
    return news.prepare_batch(raw(spark, folder), NOW)


@query("b4_article_quality", sql(f"SELECT id AS polygon_id, issues, {near('quality_score', 4)} AS quality_score, CAST(is_valid AS INTEGER) AS is_valid FROM prepared", *A, **P))
def b4(spark, folder):
    p = prepared(spark, folder)
    return p.select("polygon_id", F.array_join("issues", ";").alias("issues"), rounded("quality_score", 4).alias("quality_score"), F.col("is_valid").cast("int").alias("is_valid"))


@query("b5_keywords", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang || ',' || source WHEN 1 THEN lang || ',' || source WHEN 2 THEN '' WHEN 3 THEN lang ELSE source END AS keywords FROM documents""")
def b5(spark, folder):
    k, lang, src = F.col("doc_id"), F.col("lang"), F.col("source")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit('["'), lang, F.lit('", "'), src, F.lit('"]'))).when(k % 5 == 1, F.concat(F.lit("["), lang, F.lit(" , "), src, F.lit(", ]")))
        .when(k % 5 == 2, None).when(k % 5 == 3, F.concat(F.lit('"'), lang, F.lit('"'))).otherwise(F.concat(F.lit(" "), src)))
    d = views.table(spark, folder, "documents").withColumn("kw", text)
    return d.select("doc_id", F.array_join(news.keyword_list("kw"), ",").alias("keywords"))


@query("b6_newest_distinct", sql("""SELECT id, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_utc FROM articles
WHERE published_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09' ORDER BY published_at DESC LIMIT 100""", "articles"))
def b6(spark, folder):
    copies = views.articles(spark, folder).select("id", "published_utc", F.explode("tickers").alias("ticker"))
    return news.newest_distinct(copies, "2024-01-03", "2024-01-09", 100).select("id", "published_utc")


def stored(p):
    """A store holding two thirds of the valid ones of the prepared articles ``p``, a third of those with another title."""
    k = F.col("polygon_id").cast("long")
    p = p.where("is_valid").withColumn("published_at", news.published()).where(F.col("published_at").isNotNull())
    return p.where(k % 3 != 0).withColumns({
        "title": F.when(k % 3 == 1, F.concat(F.lit("Old "), F.substring("title", 1, 900))).otherwise(F.col("title")),
        "tickers": F.when(k % 2 == 0, F.array(F.lit("OLD"))).otherwise(F.col("tickers"))}).select(*news.STORED)


MERGED = """SELECT id AS polygon_id, k, title, CASE WHEN k % 3 = 0 THEN 'new' WHEN len(tickers) > 0 OR sentiment IS NOT NULL OR k % 3 = 1 THEN 'updated' ELSE 'skipped' END AS outcome,
  CASE WHEN len(tickers) > 0 OR k % 3 = 0 THEN array_to_string(list_sort(tickers), ',') WHEN k % 2 = 0 THEN 'OLD' ELSE '' END AS tickers FROM prepared WHERE is_valid AND pub IS NOT NULL"""


@query("b7_store_articles", sql("SELECT polygon_id, title, outcome, tickers FROM merged", *A, **P, merged=MERGED))
def b7(spark, folder):
    out = news.store_batch(stored(prepared(spark, folder)), prepared(spark, folder))
    return out.select("polygon_id", "title", "outcome", F.array_join(F.array_sort("tickers"), ",").alias("tickers"))


@query("w6_upsert_articles", sql("SELECT polygon_id, title, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 = 0 THEN 'absent' ELSE 'kept' END ELSE outcome END AS outcome FROM (SELECT polygon_id, k, outcome, CASE WHEN k % 5 = 0 AND k % 3 = 1 THEN 'Old ' || left(title, 900) ELSE title END AS title FROM merged) WHERE NOT (k % 5 = 0 AND k % 3 = 0)", *A, **P, merged=MERGED))
def w6(spark, folder):
    p = prepared(spark, folder).where("is_valid").withColumn("published_at", news.published()).where(F.col("published_at").isNotNull()).select(*news.STORED)
    return merge.upsert_articles(stored(prepared(spark, folder)), p.where(F.col("polygon_id").cast("long") % 5 != 0)).select("polygon_id", "title", "outcome")


def store(spark, folder):
    """All valid articles as stored rows."""
    p = prepared(spark, folder).where("is_valid").withColumn("published_at", news.published()).where(F.col("published_at").isNotNull())
    return p.select(*news.STORED)


STORE = "SELECT id AS polygon_id, title, pub AS published_at, tickers, sentiment, publisher_name FROM prepared WHERE is_valid AND pub IS NOT NULL"
ST = P | {"store": STORE}
FMT, SFMT = "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss"


@query("b8_articles_of_ticker", sql(f"""SELECT polygon_id, strftime(published_at, '{FMT}') AS published FROM store WHERE list_contains(tickers, 'T000005')
AND published_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'""", *A, **ST))
def b8(spark, folder):
    out = news.of_ticker(store(spark, folder), "t000005", "2024-01-01", "2024-01-31")
    return out.select("polygon_id", F.date_format("published_at", SFMT).alias("published"))


@query("b9_retention", sql("SELECT polygon_id FROM store WHERE published_at >= TIMESTAMP '2024-01-20' - INTERVAL 1095 DAY", *A, **ST))
def b9(spark, folder):
    return news.retained(store(spark, folder), NOW).select("polygon_id")


def ladder(x, steps, rest):
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN 0 " + " ".join(f"WHEN {x} >= {a!r} THEN {b}" for a, b in steps) + f" ELSE {rest} END"


CAP = ladder("market_cap", [(500e9, 40), (100e9, 35), (50e9, 30), (10e9, 25), (1e9, 15)], 5)
VOL = ladder("avg_volume", [(50e6, 30), (20e6, 25), (10e6, 20), (5e6, 15), (1e6, 10)], 5)
PRIO = f"""SELECT ticker, CAST({CAP} + {VOL} AS DOUBLE) AS priority_score, 0 AS is_major,
  CASE WHEN market_cap >= 100e9 THEN 'large_cap' WHEN market_cap >= 10e9 THEN 'mid_cap' ELSE 'small_cap' END AS category FROM tickers WHERE active"""


@query("b10_ticker_priority", sql(f"SELECT ticker, priority_score, is_major, category, {near('priority_score / 100', 4)} AS relevance_score FROM prio ORDER BY priority_score DESC, ticker LIMIT 50", "tickers", prio=PRIO))
def b10(spark, folder):
    out = news.prioritised(views.tickers(spark, folder), 50, include_funds=False).withColumn("is_major", F.col("is_major").cast("int"))
    return shown(out, ["ticker", "priority_score", "is_major", "category"], {"relevance_score": 4})


@query("b11_ticker_record", sql("SELECT ticker, name, market, 'us' AS locale, CAST(active AS INTEGER) AS active, type, market_cap FROM tickers", "tickers"))
def b11(spark, folder):
    from ..operators.ingest import ticker_record

    none = F.lit(None).cast("string")
    raw_ = views.tickers(spark, folder).withColumns({
        "ticker": F.lower("ticker"), "market": F.when(F.col("id") % 2 == 0, F.col("market")), "locale": none, "primary_exchange": none, "currency_name": none,
        "active": F.when(~F.col("active"), F.lit(False))})
    return ticker_record(raw_).select("ticker", "name", "market", "locale", F.col("active").cast("int").alias("active"), "type", "market_cap")


WINDOWS = """SELECT t.ticker, TIMESTAMP '2023-11-01' + to_days(CAST(10 * w AS INTEGER)) AS s, least(TIMESTAMP '2023-11-01' + to_days(CAST(10 * w + 10 AS INTEGER)), TIMESTAMP '2024-02-05') AS e
FROM tickers t, (SELECT unnest(range(10)) AS w)"""
TROWS = "SELECT polygon_id, published_at, unnest(tickers) AS ticker FROM store"


@query("b12_empty_windows", sql(f"""SELECT ticker, strftime(s, '{FMT}') AS window_start, strftime(e, '{FMT}') AS window_end FROM windows w
WHERE NOT EXISTS (SELECT 1 FROM trows a WHERE a.ticker = w.ticker AND a.published_at BETWEEN w.s AND w.e)""", "tickers", *A, **ST, trows=TROWS, windows=WINDOWS))
def b12(spark, folder):
    out = news.empty_windows(views.tickers(spark, folder), store(spark, folder), "2023-11-01", "2024-02-05", 10)
    return out.select("ticker", F.date_format("window_start", SFMT).alias("window_start"), F.date_format("window_end", SFMT).alias("window_end"))


@query("b14_news_batch", sql("""SELECT (SELECT count(*) FROM prepared) AS fetched, count(*) FILTER (outcome = 'new') AS stored, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'skipped') + (SELECT count(*) FROM prepared WHERE NOT coalesce(is_valid, false)) AS skipped FROM merged""", *A, **P, merged=MERGED))
def b14(spark, folder):
    p = prepared(spark, folder)
    return news.batch_counts(p, news.store_batch(stored(p), p))


@query("b15_publication_time", sql(f"""SELECT id, strftime(pub, '{FMT}') AS published, CAST(title <> '' AND article_url IS NOT NULL AND published_utc <> '' AS INTEGER) AS complete FROM timed""", *A, damaged=DAMAGED, timed=TIMED))
def b15(spark, folder):
    return raw(spark, folder).select("id", F.date_format(news.published(), SFMT).alias("published"), news.required_present().cast("int").alias("complete"))


@query("b16_ticker_lookup", sql("""SELECT t.ticker, coalesce(p.priority_score, 0) AS priority_score, coalesce(p.category, 'unknown') AS category
FROM tickers t LEFT JOIN (SELECT * FROM prio ORDER BY priority_score DESC, ticker LIMIT 40) p USING (ticker)""", "tickers", prio=PRIO))
def b16(spark, folder):
    t = views.tickers(spark, folder)
    return news.lookup(t.select(F.lower("ticker").alias("ticker")), news.prioritised(t, 40)).select("ticker", "priority_score", "category")


@query("b16_limit_per_ticker", sql(f"""SELECT ticker, polygon_id, rank_in_ticker FROM (SELECT ticker, polygon_id, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, polygon_id) AS rank_in_ticker FROM trows)
WHERE rank_in_ticker <= 3""", *A, **ST, trows=TROWS))
def b16b(spark, folder):
    rows = news.ticker_rows(store(spark, folder)).select("ticker", F.col("polygon_id").alias("id"), F.date_format("published_at", SFMT).alias("published_utc"))
    return news.per_ticker_limit(rows, 3).select("ticker", F.col("id").alias("polygon_id"), "rank_in_ticker")


@query("j10_articles_with_children", sql("SELECT t.polygon_id, t.ticker, s.sentiment FROM trows t JOIN store s USING (polygon_id) WHERE s.sentiment IS NOT NULL", *A, **ST, trows=TROWS))
def j10(spark, folder):
    s = store(spark, folder)
    i = news.insight_rows(s).where(F.col("sentiment").isNotNull()).select("polygon_id", "sentiment")
    return news.ticker_rows(s).select("polygon_id", "ticker").join(i, "polygon_id")


@query("a3_news_statistics", sql("""SELECT 'total' AS section, 'all' AS key, count(*) AS articles FROM rs UNION ALL SELECT 'ticker', ticker, count(*) FROM (SELECT unnest(tickers) AS ticker FROM rs) GROUP BY 2
UNION ALL SELECT 'sentiment', sentiment, count(*) FROM rs WHERE sentiment IS NOT NULL GROUP BY 2 UNION ALL SELECT 'publisher', publisher_name, count(*) FROM rs GROUP BY 2""",
    *A, **ST, rs="SELECT * FROM store WHERE published_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-12'"))
def a3(spark, folder):
    return news.statistics(store(spark, folder), "2024-01-02", "2024-01-12")


@query("a4_latest_articles", sql(f"""SELECT ticker, strftime(max(published_at), '{FMT}') AS latest, count(*) FILTER (published_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS recent_articles
FROM trows GROUP BY 1""", *A, **ST, trows=TROWS))
def a4(spark, folder):
    return news.latest_dates(store(spark, folder), NOW).select("ticker", F.date_format("latest", SFMT).alias("latest"), "recent_articles")


@query("a4_latest_overall", sql(f"SELECT strftime(max(published_at), '{FMT}') AS latest FROM store", *A, **ST))
def a4b(spark, folder):
    return news.latest_overall(store(spark, folder)).select(F.date_format("latest", SFMT).alias("latest"))
