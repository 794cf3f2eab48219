"""Dividend records and dividend features on the bar panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import timeline


def map_to_bars(bars: DataFrame, events: DataFrame, reach: int = 3) -> DataFrame:
    """Nearest bar within +-reach days of each (ticker, ex_dividend_date), earlier bar on ties.

    A range join kept as a hash join: events are copied once per day of reach, so the
    join is an equality on (ticker, date), and the best match is a min_by aggregate.
    """
    copies = events.select(
        "*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_off")
    ).withColumn("date", F.date_add("ex_dividend_date", F.col("_off")))
    hits = copies.join(bars.select("ticker", "date"), ["ticker", "date"])
    keys = events.columns
    return hits.groupBy(*keys).agg(
        F.min_by("date", F.struct(F.abs("_off"), F.col("date"))).alias("date")
    )


def per_bar(bars: DataFrame, dividends: DataFrame, reach: int = 3) -> DataFrame:
    """(ticker, date, dividend_amount): payments of one ex-date add up; of two ex-dates on
    one bar the later wins."""
    events = dividends.where(F.col("ex_dividend_date").isNotNull()).groupBy("ticker", "ex_dividend_date").agg(
        F.sum("cash_amount").alias("amount")
    )
    return map_to_bars(bars, events, reach).groupBy("ticker", "date").agg(
        F.max_by("amount", "ex_dividend_date").alias("dividend_amount")
    )


def event_distance(panel: DataFrame, event: str) -> DataFrame:
    """Calendar days since the last and to the next row where ``event`` is 1, both strict."""
    w = timeline()
    at = F.when(F.col(event) == 1, F.col("date"))
    last = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return panel.withColumns({
        "days_since_last_dividend": F.datediff("date", last), "days_to_next_dividend": F.datediff(nxt, F.col("date")),
    })


def dividend_features(bars: DataFrame, dividends: DataFrame, reach: int = 3) -> DataFrame:
    """Amount, yield, ex-date flag and distances, one row per bar."""
    out = bars.select("ticker", "date", "close").join(per_bar(bars, dividends, reach), ["ticker", "date"], "left")
    out = out.withColumns({
        "dividend_yield": F.try_divide("dividend_amount", "close"),
        "is_ex_dividend": F.col("dividend_amount").isNotNull().cast("int"),
    })
    return event_distance(out, "is_ex_dividend").drop("close")


def with_dividends(features: DataFrame, extra: DataFrame) -> DataFrame:
    """Adds the dividend columns; where a column exists on both sides the panel's value stays."""
    shared = [c for c in extra.columns if c in features.columns and c not in ("ticker", "date")]
    side = extra.withColumnsRenamed({c: f"_x_{c}" for c in shared})
    out = features.join(side, ["ticker", "date"], "left")
    return out.withColumns({c: F.coalesce(c, f"_x_{c}") for c in shared}).drop(*[f"_x_{c}" for c in shared])


def transform_records(raw: DataFrame) -> DataFrame:
    """Vendor dividend records (text fields) to typed rows plus ``reason`` for rejects.

    A zero or empty amount falls through to the next name; unparsable dates become null.
    """

    def first_text(*names):
        present = [c for c in names if c in raw.columns]
        return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in present]) if present else F.lit(None).cast("string")

    def first_amount(*names):
        present = [c for c in names if c in raw.columns]
        texts = [F.when((F.col(c) != "") & ~(F.coalesce(F.col(c).try_cast("double"), F.lit(1.0)) == 0), F.col(c)) for c in present]
        # The last name is taken as it is, so a lone zero counts as an amount there.
        return F.coalesce(*texts, F.col("cash") if "cash" in raw.columns else F.lit(None).cast("string"))

    def day(c):
        return (F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date") if c in raw.columns
                else F.lit(None).cast("date"))

    key, amount = first_text("id", "dividend_id", "polygon_id"), first_amount("cash_amount", "amount", "cash")
    cash = amount.try_cast("decimal(18,6)")
    reason = (
        F.when(key.isNull(), "missing_id").when(amount.isNull(), "missing_cash_amount")
        .when(cash.isNull(), "invalid_cash_amount")
        .when((F.col("currency") != "") & (F.length("currency") != 3), "invalid_currency")
    )
    return raw.select(
        key.alias("id"), "ticker_id", cash.alias("cash_amount"), "currency",
        *[day(c).alias(c) for c in ("declaration_date", "ex_dividend_date", "pay_date", "record_date")],
        "frequency", first_text("type", "dividend_type").alias("dividend_type"),
        F.to_json(F.struct(*raw.columns)).alias("raw_payload"), reason.alias("reason"),
    )


def accepted(transformed: DataFrame) -> DataFrame:
    return transformed.where(F.col("reason").isNull()).drop("reason")


def rejected(transformed: DataFrame) -> DataFrame:
    """Bad records with their reason, for a quarantine table."""
    return transformed.where(F.col("reason").isNotNull()).select("reason", F.col("raw_payload").alias("payload"))


def record_counts(transformed: DataFrame) -> DataFrame:
    """Per ticker: processed, accepted, skipped (no id), failed."""
    r = F.col("reason")
    return transformed.groupBy("ticker_id").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(r.isNull()).alias("accepted"),
        F.count_if(r == "missing_id").alias("skipped"),
        F.count_if(r.isNotNull() & (r != "missing_id")).alias("failed"),
    )
