"""Validation: rule columns, batch statistics, gap and outlier reports, data guards."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import history, prev, relative_change, whole

OHLCV = ("open", "high", "low", "close", "volume")


def issues(*rules: tuple[Column, str]) -> Column:
    """Array of the names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in rules]))


def clean_symbol(c: str = "ticker") -> Column:
    return F.upper(F.trim(c))


def bar_errors(today) -> Column:
    """Every rule is checked on every record; comparisons with null do not count."""
    o, h, low, c, v = (F.col(x) for x in OHLCV)
    t = clean_symbol()
    return issues(
        (F.coalesce(F.length(t), F.lit(0)) == 0, "ticker_empty"),
        (F.length("ticker") > 10, "ticker_too_long"),
        ((F.length(t) > 0) & ~t.rlike(r"^(?=.*[A-Z0-9])[A-Z0-9./-]+$"), "ticker_format"),
        (o.isNull() | ~(o > 0), "open_not_positive"),
        (h.isNull() | ~(h > 0), "high_not_positive"),
        (low.isNull() | ~(low > 0), "low_not_positive"),
        (c.isNull() | ~(c > 0), "close_not_positive"),
        (h < low, "high_below_low"), (h < o, "high_below_open"), (h < c, "high_below_close"),
        (low > o, "low_above_open"), (low > c, "low_above_close"),
        (v < 0, "volume_negative"), (v > 10**12, "volume_too_high"),
        (F.col("adjusted_close") <= 0, "adjusted_close_not_positive"),
        (F.col("date") > F.lit(today).cast("date"), "date_in_future"),
    )


def check_bars(bars: DataFrame, today) -> DataFrame:
    """Adds errors (array of rule names) and valid; tickers come out trimmed and upper-case."""
    return (
        bars.withColumn("errors", bar_errors(today))
        .withColumn("ticker", clean_symbol())
        .withColumn("valid", F.size("errors") == 0)
    )


def repair_vwap(bars: DataFrame, tolerance: float = 0.2, digits: int | None = 4) -> DataFrame:
    """A vwap that is not positive or far outside the range is replaced by a typical price."""
    v, h, low, c = (F.col(x) for x in ("vwap", "high", "low", "close"))
    typical = F.when(F.col("volume") > 0, (h + low + c * 2) / 4).otherwise((h + low + c) / 3)
    if digits is not None:
        typical = F.round(typical, digits)
    bad = (v <= 0) | (v < low * (1 - tolerance)) | (v > h * (1 + tolerance))
    return bars.withColumn("vwap", F.when(bad, typical).otherwise(v))


def batch_statistics(checked: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("valid")
    return checked.groupBy("ticker").agg(
        n.alias("total"), ok.alias("valid_records"), (n - ok).alias("invalid_records"),
        (ok / n).alias("success_rate"), F.sum(F.size("errors")).alias("errors"),
    )


def split_valid(checked: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects). Strict mode fails the job on the first invalid row."""
    if strict:
        failure = F.raise_error(F.concat(F.lit("invalid bar: "), F.array_join("errors", ","))).cast("boolean")
        checked = checked.withColumn("valid", F.when(F.col("valid"), True).otherwise(failure))
    return checked.where("valid").drop("errors", "valid"), checked.where(~F.col("valid")).drop("valid")


def gaps(bars: DataFrame, days: int = 3) -> DataFrame:
    """Consecutive dates of a ticker more than ``days`` apart."""
    return (
        bars.select("ticker", prev("date").alias("gap_start"), F.col("date").alias("gap_end"))
        .withColumn("gap_days", F.datediff("gap_end", "gap_start"))
        .where(F.col("gap_days") > days)
    )


def price_outliers(bars: DataFrame, limit: float = 0.2, min_rows: int = 10) -> DataFrame:
    change = F.abs(relative_change("close")) * 100
    return (
        bars.select("ticker", "date", change.alias("change_pct"), history().alias("_n"))
        .where((F.col("change_pct") > limit * 100) & (F.col("_n") >= min_rows))
        .drop("_n")
    )


def volume_outliers(bars: DataFrame, times: float = 10, min_rows: int = 10) -> DataFrame:
    usual = F.avg(F.when(F.col("volume") > 0, F.col("volume"))).over(whole())
    return (
        bars.select("ticker", "date", "volume", usual.alias("avg_volume"), history().alias("_n"))
        .where((F.col("volume") > F.col("avg_volume") * times) & (F.col("_n") >= min_rows))
        .drop("_n")
    )


def quality_metrics(bars: DataFrame, today) -> DataFrame:
    """Per ticker: validation counts plus numbers of gaps and outliers, in one pass."""
    checked = check_bars(bars, today)
    usual = F.avg(F.when(F.col("volume") > 0, F.col("volume"))).over(whole())
    marked = checked.where("valid").select(
        "ticker", F.datediff("date", prev("date")).alias("gap"),
        F.abs(relative_change("close")).alias("move"), "volume", usual.alias("usual"),
        history().alias("n"),
    )
    enough = F.col("n") >= 10
    found = marked.groupBy("ticker").agg(
        F.count_if(F.col("gap") > 3).alias("gaps"),
        F.count_if(enough & (F.col("move") * 100 > 20)).alias("price_outliers"),
        F.count_if(enough & (F.col("volume") > F.col("usual") * 10)).alias("volume_outliers"),
    )
    return batch_statistics(checked).join(found, "ticker", "left").fillna(0)


def clean_tickers(raw: DataFrame) -> DataFrame:
    """Ticker records with defaults; rows without a name are not valid."""
    name = F.trim("name")
    return raw.select(
        clean_symbol().alias("ticker"), name.alias("name"),
        F.coalesce("market", F.lit("stocks")).alias("market"),
        F.coalesce("locale", F.lit("us")).alias("locale"),
        F.coalesce("active", F.lit(True)).alias("active"),
        (F.coalesce(F.length(name), F.lit(0)) > 0).alias("valid"),
    )


def clean_series(bars: DataFrame) -> DataFrame:
    """Drops rows with missing OHLCV, broken OHLC order or non-positive prices."""
    o, h, low, c, v = (F.col(x) for x in OHLCV)
    return bars.dropna(subset=list(OHLCV)).where(
        (h >= low) & (h >= o) & (h >= c) & (low <= o) & (low <= c)
        & (o > 0) & (h > 0) & (low > 0) & (c > 0) & (v >= 0)
    )


def series_warnings(bars: DataFrame) -> DataFrame:
    """Per ticker: moves above 50% and gaps above 7 days."""
    steps = bars.select(
        "ticker", F.abs(relative_change("close")).alias("move"), F.datediff("date", prev("date")).alias("gap")
    )
    return steps.groupBy("ticker").agg(
        F.count_if(F.col("move") > 0.5).alias("extreme_moves"), F.count_if(F.col("gap") > 7).alias("large_gaps")
    )


def enough_data(bars: DataFrame, min_bars: int = 200, max_missing: float = 0.05) -> DataFrame:
    """Bars of tickers with enough rows and few missing values."""
    ok = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNull().cast("int")).alias(f"m_{c}") for c in OHLCV]
    ).where((F.col("n") >= min_bars) & (F.greatest(*[F.col(f"m_{c}") for c in OHLCV]) <= max_missing))
    return bars.join(ok.select("ticker"), "ticker", "left_semi")


def standard_names(df: DataFrame) -> DataFrame:
    """OHLCV columns in lower case, whatever their case was."""
    for c in df.columns:
        if c.lower() in OHLCV and c != c.lower():
            df = df.withColumnRenamed(c, c.lower())
    return df


def category_quality(features: DataFrame, columns: list[str]) -> DataFrame:
    """Per ticker: 100 * (1 - share of missing values), and whether any value is infinite."""
    # Two numbers a row instead of an aggregate per column.
    row = features.select(
        "ticker", sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)).alias("missing"),
        F.greatest(*[(F.abs(F.col(c)) == float("inf")).cast("int") for c in columns], F.lit(0), F.lit(0)).alias("infinite"),
    )
    missing = F.sum("missing")
    return row.groupBy("ticker").agg(
        (F.lit(100.0) * (1 - missing / (F.count(F.lit(1)) * len(columns)))).alias("quality_score"),
        F.coalesce(F.max("infinite"), F.lit(0)).alias("has_infinite"),
    )


def valid_results(features: DataFrame, columns: list[str], min_score: float = 50.0) -> DataFrame:
    """Rows of tickers whose columns score high enough and hold no infinite value."""
    good = category_quality(features, columns).where((F.col("quality_score") >= min_score) & (F.col("has_infinite") == 0))
    return features.join(good.select("ticker"), "ticker", "left_semi")


def overall_quality(features: DataFrame, columns: list[str], min_values: int = 10) -> DataFrame:
    """100 * (1 - missing) * (1 - infinite) * (1 - min(IQR outliers, 0.5)) per ticker.

    Quartiles are windows over a whole ticker, so they stay in the panel's partitions, and a task holds the values of one
    ticker at a time. Rows are then added up over their columns before the one aggregate.
    """
    values = {i: F.col(c).cast("double") for i, c in enumerate(columns)}
    marked = features.select("ticker", *[x.alias(f"_v{i}") for i, x in values.items()])
    marked = marked.select(
        "*", *[F.percentile(f"_v{i}", F.array(F.lit(0.25), F.lit(0.75))).over(whole()).alias(f"_q{i}") for i in values],
        *[F.count(f"_v{i}").over(whole()).alias(f"_n{i}") for i in values],
    )
    cells = F.array(*[
        F.struct(F.col(f"_v{i}").alias("v"), F.col(f"_q{i}")[0].alias("q1"), F.col(f"_q{i}")[1].alias("q3"), (F.col(f"_n{i}") > min_values).alias("on"))
        for i in values
    ])

    def outlier(c):
        reach = 1.5 * (c["q3"] - c["q1"])
        return c["on"] & ((c["v"] < c["q1"] - reach) | (c["v"] > c["q3"] + reach))

    def count(test):
        return F.size(F.filter("cells", test))

    row = marked.select("ticker", cells.alias("cells")).select(
        "ticker", count(lambda c: c["v"].isNotNull()).alias("present"), count(lambda c: F.abs(c["v"]) == float("inf")).alias("infinite"),
        count(lambda c: c["on"] & c["v"].isNotNull()).alias("tested"), count(outlier).alias("outliers"),
    )
    counts = row.groupBy("ticker").agg(
        (F.count(F.lit(1)) * len(columns)).alias("n"), *[F.sum(x).alias(x) for x in ("present", "infinite", "tested", "outliers")]
    )
    share = F.coalesce(F.try_divide(F.col("outliers").cast("double"), F.col("tested").cast("double")), F.lit(0.0))
    score = (F.col("present") / F.col("n")) * (1 - F.col("infinite") / F.col("n")) * (1 - F.least(share, F.lit(0.5))) * 100
    return counts.select("ticker", score.alias("quality_score"))


def on_weekdays(df: DataFrame, days=(0, 4), column: str = "date") -> DataFrame:
    """Rows whose date falls on the given weekdays (Monday is 0)."""
    return df.where(F.weekday(column).isin(list(days)))


def ticker_list(tickers: DataFrame) -> DataFrame:
    """Cleaned symbol and whether it has the form of a ticker (dots and hyphens allowed)."""
    t = clean_symbol()
    ok = F.length(t).between(1, 10) & t.rlike(r"^(?=.*[A-Z0-9])[A-Z0-9.-]+$")
    return tickers.select(F.col("ticker").alias("given"), t.alias("cleaned"), F.coalesce(ok, F.lit(False)).cast("int").alias("valid"))


# Substrings that decide a feature's category, first match wins.
CATEGORY_WORDS = {
    "trend": ("sma", "ema", "macd", "ichimoku"),
    "momentum": ("rsi", "stoch", "roc", "williams"),
    "volatility": ("bb", "bollinger", "atr", "volatility"),
    "volume": ("obv", "vpt", "ad_line", "volume", "mfi"),
}


def category_of(name: str) -> str:
    """Category by substring, so a few names land in an unexpected one (OBV_SMA_10 is trend)."""
    low = name.lower()
    return next((c for c, words in CATEGORY_WORDS.items() if any(w in low for w in words)), "basic")


def columns_in(names: list[str], categories: list[str]) -> list[str]:
    return [n for n in names if category_of(n) in categories]


def check_settings(batch_size: int = 1, min_points: int = 50, missing=(0.0, 1.0), ordered=()) -> None:
    """Raises on settings no job can run with."""
    problems = []
    if batch_size < 1:
        problems.append("batch_size must be at least 1")
    if min_points < 50:
        problems.append("min_points must be at least 50")
    if not all(0 <= m <= 1 for m in missing):
        problems.append("shares must lie in [0, 1]")
    problems += [f"{a} must be below {b}" for a, b in ordered if not a < b]
    if problems:
        raise ValueError("; ".join(problems))
