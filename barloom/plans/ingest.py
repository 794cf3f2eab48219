"""Queries: sources, validation, upserts and ticker reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, merge, validate
from ..sources import views
from .common import near, query, shown
from .views import sql

W = "PARTITION BY ticker ORDER BY date"

# Bars with damaged fields, derived from the volume, so that every rule has work to do.
DIRTY = """
  SELECT CASE WHEN volume % 53 = 0 THEN ' ' || lower(ticker) WHEN volume % 59 = 0 THEN ticker || '$'
      WHEN volume % 61 = 0 THEN '  ' WHEN volume % 67 = 0 THEN ticker || '.LONG' ELSE ticker END AS ticker,
    date, CASE WHEN volume % 37 = 0 THEN -open ELSE open END AS open,
    CASE WHEN volume % 43 = 0 THEN low * 0.9 ELSE high END AS high, low, close,
    CASE WHEN volume % 41 = 0 THEN -volume ELSE volume END AS volume,
    CASE WHEN volume % 47 = 0 THEN 0.0 ELSE close END AS adjusted_close,
    CASE WHEN volume % 13 = 0 THEN 0.0 WHEN volume % 17 = 0 THEN vwap * 2 ELSE vwap END AS vwap
  FROM bars"""
TODAY = "2000-06-30"


def dirty(spark, folder):
    v = F.col("volume")
    b = views.bars(spark, folder)
    t = F.col("ticker")
    return b.select(
        F.when(v % 53 == 0, F.concat(F.lit(" "), F.lower(t))).when(v % 59 == 0, F.concat(t, F.lit("$")))
        .when(v % 61 == 0, "  ").when(v % 67 == 0, F.concat(t, F.lit(".LONG"))).otherwise(t).alias("ticker"),
        "date", F.when(v % 37 == 0, -F.col("open")).otherwise(F.col("open")).alias("open"),
        F.when(v % 43 == 0, F.col("low") * 0.9).otherwise(F.col("high")).alias("high"), "low", "close",
        F.when(v % 41 == 0, -v).otherwise(v).alias("volume"),
        F.when(v % 47 == 0, 0.0).otherwise(F.col("close")).alias("adjusted_close"),
        F.when(v % 13 == 0, 0.0).when(v % 17 == 0, F.col("vwap") * 2).otherwise(F.col("vwap")).alias("vwap"),
    )


def raw(spark, folder):
    """The same rows in the vendor's field names."""
    return dirty(spark, folder).select(
        F.trim("ticker").alias("ticker"), (F.unix_date("date").cast("long") * 86_400_000).alias("ms"),
        F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
        F.when(F.col("adjusted_close") == 0, F.lit(None)).otherwise(F.col("volume")).cast("double").alias("v"),
        F.col("vwap").alias("vw"),
    )


RAW = """SELECT trim(ticker) AS ticker, epoch_ms(date) AS ms, open AS o, high AS h, low AS l, close AS c,
  CASE WHEN adjusted_close = 0 THEN NULL ELSE CAST(volume AS DOUBLE) END AS v, vwap AS vw FROM dirty"""


@query("s1_bars_from_raw", sql("""
SELECT ticker, CAST(epoch_ms(ms) AS DATE) AS date, o AS open, h AS high, l AS low, c AS close,
  CAST(v AS BIGINT) AS volume, vw AS vwap, c AS adjusted_close
FROM raw WHERE o > 0 AND h > 0 AND l > 0 AND c > 0 AND v >= 0""", "bars", dirty=DIRTY, raw=RAW))
def s1(spark, folder):
    return ingest.bars_from_raw(raw(spark, folder))


@query("s2_records_from_raw", sql("""
SELECT ticker, CAST(epoch_ms(ms) AS DATE) AS date, o AS open, h AS high, l AS low, c AS close,
  CAST(v AS BIGINT) AS volume, vw AS vwap FROM raw WHERE v IS NOT NULL""", "bars", dirty=DIRTY, raw=RAW))
def s2(spark, folder):
    out = ingest.records_from_raw(raw(spark, folder))
    return out.select("ticker", F.col("timestamp").cast("date").alias("date"), "open", "high", "low", "close", "volume", "vwap")


@query("s3_grouped_daily", """
SELECT l_suppkey + 1 AS ticker_id, CAST(l_shipdate AS DATE) AS date,
  last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS price,
  last(l_quantity ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS quantity
FROM lineitem GROUP BY 1, 2""")
def s3(spark, folder):
    rows = views.table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") + 1).alias("ticker_id"), F.col("l_shipdate").cast("date").alias("date"),
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
    )
    return ingest.last_record(rows, ["ticker_id", "date"], ["l_orderkey", "l_linenumber", "price", "quantity"], ["price", "quantity"])


@query("s4_history_of_ticker", sql("""
SELECT ticker, date, open, high, low, close, volume FROM bars
WHERE ticker = 'T000003' AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""", "bars"))
def s4(spark, folder):
    out = ingest.bars_of(views.bars(spark, folder), "T000003", "1997-01-01", "1999-12-31")
    return out.select("ticker", "date", "open", "high", "low", "close", "volume")


METRICS = f"""
  SELECT c.ticker, count(*) AS total, count(*) FILTER (valid) AS valid_records,
    count(*) FILTER (NOT valid) AS invalid_records, count(*) FILTER (valid) / count(*) AS success_rate
  FROM checked c GROUP BY 1"""
ERRORS = {
    "ticker_empty": "length(t) = 0", "ticker_too_long": "length(ticker) > 10",
    "ticker_format": "length(t) > 0 AND NOT (regexp_matches(t, '^[A-Z0-9./-]+$') AND regexp_matches(t, '[A-Z0-9]'))",
    "open_not_positive": "open <= 0", "high_not_positive": "high <= 0", "low_not_positive": "low <= 0",
    "close_not_positive": "close <= 0", "high_below_low": "high < low", "high_below_open": "high < open",
    "high_below_close": "high < close", "low_above_open": "low > open", "low_above_close": "low > close",
    "volume_negative": "volume < 0", "volume_too_high": "volume > 1000000000000",
    "adjusted_close_not_positive": "adjusted_close <= 0", "date_in_future": f"date > DATE '{TODAY}'",
}
CHECKED = "SELECT * EXCLUDE (ticker, t), t AS ticker, errors = '' AS valid FROM (SELECT *, concat_ws(';', " + ", ".join(
    f"CASE WHEN {c} THEN '{n}' END" for n, c in ERRORS.items()) + ") AS errors FROM (SELECT *, upper(trim(ticker)) AS t FROM dirty))"


@query("s5_bulk_history", sql(f"""
SELECT m.ticker, total, valid_records, invalid_records, {near('success_rate', 6)} AS success_rate,
  coalesce(gaps, 0) AS gaps, coalesce(price_outliers, 0) AS price_outliers, coalesce(volume_outliers, 0) AS volume_outliers
FROM metrics m LEFT JOIN (
  SELECT ticker, count(*) FILTER (gap > 3) AS gaps, count(*) FILTER (n >= 10 AND move * 100 > 20) AS price_outliers,
    count(*) FILTER (n >= 10 AND volume > 10 * usual) AS volume_outliers
  FROM (SELECT ticker, date - lag(date) OVER ({W}) AS gap, abs(close / lag(close) OVER ({W}) - 1) AS move, volume,
      avg(volume) FILTER (volume > 0) OVER (PARTITION BY ticker) AS usual, count(*) OVER (PARTITION BY ticker) AS n
    FROM checked WHERE valid) GROUP BY 1) USING (ticker)""", "bars", dirty=DIRTY, checked=CHECKED, metrics=METRICS))
def s5(spark, folder):
    out = validate.quality_metrics(dirty(spark, folder), TODAY)
    return shown(out, ["ticker", "total", "valid_records", "invalid_records", "gaps", "price_outliers", "volume_outliers"], {"success_rate": 6})


@query("s6_date_range_coverage", sql("""
SELECT d.date, coalesce(n, 0) AS tickers_loaded, CAST(coalesce(n, 0) > 0 AS INTEGER) AS successful
FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM bars)::TIMESTAMP, (SELECT max(date) FROM bars)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date) d
LEFT JOIN (SELECT date, count(*) AS n FROM bars GROUP BY 1) USING (date) WHERE isodow(d.date) < 6""", "bars"))
def s6(spark, folder):
    return ingest.coverage(views.bars(spark, folder))


@query("s7_weekday_calendar", """
SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(
  (SELECT min(o_orderdate) FROM orders)::TIMESTAMP, (SELECT max(o_orderdate) FROM orders)::TIMESTAMP, INTERVAL 1 DAY)) AS d)
WHERE isodow(d) < 6""")
def s7(spark, folder):
    days = views.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return ingest.weekdays(spark, days.agg(F.min("d")).scalar(), days.agg(F.max("d")).scalar())


@query("s8_bars_limited", sql("""
SELECT ticker, date, close, volume FROM bars WHERE ticker = 'T000002' AND date >= DATE '1998-01-01' ORDER BY date LIMIT 20""", "bars"))
def s8(spark, folder):
    out = ingest.bars_of(views.bars(spark, folder), "T000002", "1998-01-01", limit=20)
    return out.select("ticker", "date", "close", "volume")


CLEAN = """SELECT * FROM dirty WHERE high >= low AND high >= open AND high >= close AND low <= open AND low <= close
  AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0"""


@query("s9_feature_input", sql("SELECT ticker, date, open, high, low, close, adjusted_close, vwap, volume FROM clean",
                               "bars", dirty=DIRTY, clean=CLEAN))
def s9(spark, folder):
    return ingest.feature_input(dirty(spark, folder))


@query("s10_active_tickers", sql("SELECT id, ticker, name, type FROM tickers WHERE active ORDER BY ticker", "tickers"))
def s10(spark, folder):
    return ingest.active_tickers(views.tickers(spark, folder)).select("id", "ticker", "name", "type")


@query("s11_distinct_tickers", sql("SELECT DISTINCT ticker FROM bars ORDER BY 1", "bars"))
def s11(spark, folder):
    return ingest.distinct_tickers(views.bars(spark, folder))


@query("s12_ticker_metadata", sql("SELECT id, ticker, name, market, type, sic_code FROM tickers", "tickers"))
def s12(spark, folder):
    return ingest.ticker_metadata(views.tickers(spark, folder)).select("id", "ticker", "name", "market", "type", "sic_code")


DIVS = """SELECT d.id, t.ticker, d.ex_dividend_date, d.cash_amount FROM dividends d JOIN tickers t ON t.id = d.ticker_id
WHERE ex_dividend_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"""


@query("s13_dividends_in_range", sql(DIVS, "dividends", "tickers"))
def s13(spark, folder):
    out = ingest.dividends_with_ticker(views.dividends(spark, folder), views.tickers(spark, folder), "1996-01-01", "1999-12-31")
    return out.select("id", "ticker", "ex_dividend_date", "cash_amount")


@query("v1_bar_rules", sql("SELECT ticker, date, close, errors, CAST(valid AS INTEGER) AS valid FROM checked", "bars", dirty=DIRTY, checked=CHECKED))
def v1(spark, folder):
    out = validate.check_bars(dirty(spark, folder), TODAY)
    return out.select("ticker", "date", "close", F.array_join("errors", ";").alias("errors"), F.col("valid").cast("int").alias("valid"))


@query("v2_vwap_repair", sql(f"""
SELECT ticker, date, close, {near('''CASE WHEN vwap <= 0 OR vwap < low * 0.8 OR vwap > high * 1.2
  THEN CASE WHEN volume > 0 THEN (high + low + 2 * close) / 4 ELSE (high + low + close) / 3 END ELSE vwap END''', 4)} AS vwap
FROM dirty""", "bars", dirty=DIRTY))
def v2(spark, folder):
    return shown(validate.repair_vwap(dirty(spark, folder), digits=None), ["ticker", "date", "close"], {"vwap": 4})


@query("v3_batch_validation", sql(f"""
SELECT ticker, total, valid_records, invalid_records, {near('success_rate', 6)} AS success_rate, CAST(errors AS BIGINT) AS errors
FROM metrics JOIN (SELECT ticker, sum(CASE WHEN errors = '' THEN 0 ELSE 1 + length(errors) - length(replace(errors, ';', '')) END) AS errors
  FROM checked GROUP BY 1) USING (ticker)""", "bars", dirty=DIRTY, checked=CHECKED, metrics=METRICS))
def v3(spark, folder):
    out = validate.batch_statistics(validate.check_bars(dirty(spark, folder), TODAY))
    return shown(out, ["ticker", "total", "valid_records", "invalid_records", "errors"], {"success_rate": 6})


@query("v4_gaps", sql(f"""
SELECT * FROM (SELECT ticker, lag(date) OVER ({W}) AS gap_start, date AS gap_end,
  CAST(date - lag(date) OVER ({W}) AS INTEGER) AS gap_days FROM bars) WHERE gap_days > 3""", "bars"))
def v4(spark, folder):
    return validate.gaps(views.bars(spark, folder))


@query("v5_price_outliers", sql(f"""
SELECT ticker, date, {near('change_pct', 5)} AS change_pct FROM (
  SELECT ticker, date, abs(close / lag(close) OVER ({W}) - 1) * 100 AS change_pct, count(*) OVER (PARTITION BY ticker) AS n FROM bars)
WHERE change_pct > 20 AND n >= 10""", "bars"))
def v5(spark, folder):
    return shown(validate.price_outliers(views.bars(spark, folder)), ["ticker", "date"], {"change_pct": 5})


@query("v6_volume_outliers", sql(f"""
SELECT ticker, date, volume, {near('avg_volume', 5)} AS avg_volume FROM (
  SELECT ticker, date, volume, avg(volume) FILTER (volume > 0) OVER (PARTITION BY ticker) AS avg_volume,
    count(*) OVER (PARTITION BY ticker) AS n FROM bars) WHERE volume > 4 * avg_volume AND n >= 10""", "bars"))
def v6(spark, folder):
    return shown(validate.volume_outliers(views.bars(spark, folder), times=4), ["ticker", "date", "volume"], {"avg_volume": 5})


@query("v7_ticker_records", sql("""
SELECT ticker, trim(name) AS name, market, 'us' AS locale, CAST(active AS INTEGER) AS active, CAST(length(trim(name)) > 0 AS INTEGER) AS valid
FROM (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN '  ' ELSE name END AS name) FROM tickers)""", "tickers"))
def v7(spark, folder):
    rec = views.tickers(spark, folder).select(
        F.lower("ticker").alias("ticker"), F.when(F.col("id") % 7 == 0, "  ").otherwise(F.col("name")).alias("name"),
        F.when(F.col("id") % 5 > 0, F.col("market")).alias("market"), F.lit(None).cast("string").alias("locale"), "active")
    out = validate.clean_tickers(rec)
    return out.withColumns({c: F.col(c).cast("int") for c in ("active", "valid")})


@query("v8_series_cleaning", sql(f"""
SELECT ticker, count(*) FILTER (move > 0.5) AS extreme_moves, count(*) FILTER (gap > 7) AS large_gaps FROM (
  SELECT ticker, abs(close / lag(close) OVER ({W}) - 1) AS move, date - lag(date) OVER ({W}) AS gap
  FROM clean WHERE trim(ticker) <> '') GROUP BY 1""",
    "bars", dirty=DIRTY, clean=CLEAN))
def v8(spark, folder):
    return validate.series_warnings(validate.clean_series(dirty(spark, folder)).where(F.trim("ticker") != ""))


@query("v9_enough_data", sql("""
SELECT ticker, date, close FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY 1 HAVING count(*) >= 290)""", "bars"))
def v9(spark, folder):
    return validate.enough_data(views.bars(spark, folder), 290).select("ticker", "date", "close")


@query("v10_standard_names", sql("SELECT ticker, date, open, close, volume FROM bars", "bars"))
def v10(spark, folder):
    b = views.bars(spark, folder).withColumnsRenamed({"open": "Open", "close": "CLOSE", "volume": "Volume"})
    return validate.standard_names(b).select("ticker", "date", "open", "close", "volume")


@query("v14_weekday_filter", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE isodow(o_orderdate) IN (1, 5)""")
def v14(spark, folder):
    d = views.table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return validate.on_weekdays(d)


@query("v15_ticker_list", sql("""
SELECT given, cleaned, CAST(length(cleaned) BETWEEN 1 AND 10 AND regexp_matches(cleaned, '^[A-Z0-9.-]+$')
  AND regexp_matches(cleaned, '[A-Z0-9]') AS INTEGER) AS valid
FROM (SELECT ticker AS given, upper(trim(ticker)) AS cleaned FROM dirty)""", "bars", dirty=DIRTY))
def v15(spark, folder):
    return validate.ticker_list(dirty(spark, folder))


@query("a1_eligible_tickers", sql("""
SELECT t.ticker, t.name, t.market, count(*) AS data_points FROM tickers t JOIN bars b USING (ticker)
WHERE t.active AND t.type = 'CS' AND t.market = 'stocks' GROUP BY 1, 2, 3 HAVING count(*) >= 200""", "bars", "tickers"))
def a1(spark, folder):
    return ingest.eligible_tickers(views.bars(spark, folder), views.tickers(spark, folder))


@query("a2_true_vwap", sql(f"""
SELECT ticker, {near('''coalesce(sum((high + low + close) / 3 * volume) FILTER (ok) / sum(volume) FILTER (ok), 0.0)''', 4)} AS vwap
FROM (SELECT *, volume > 0 AND high > 0 AND low > 0 AND close > 0 AS ok FROM dirty) GROUP BY 1""", "bars", dirty=DIRTY))
def a2(spark, folder):
    from ..operators.aggregates import true_vwap

    return shown(true_vwap(dirty(spark, folder), None), ["ticker"], {"vwap": 4})


@query("j1_tickers_with_bars", sql("""
SELECT t.id, t.ticker, t.type, b.date, b.close FROM tickers t JOIN bars b USING (ticker)""", "bars", "tickers"))
def j1(spark, folder):
    t = views.tickers(spark, folder).select("id", "ticker", "type")
    return t.join(views.bars(spark, folder).select("ticker", "date", "close"), "ticker")


@query("j2_dividends_with_tickers", sql("""
SELECT d.id, t.ticker, t.name, d.ex_dividend_date, d.cash_amount FROM dividends d JOIN tickers t ON t.id = d.ticker_id""", "dividends", "tickers"))
def j2(spark, folder):
    t = views.tickers(spark, folder).select(F.col("id").alias("ticker_id"), "ticker", "name")
    return views.dividends(spark, folder).join(t, "ticker_id").drop("ticker_id")


# Upserts: the stored side is one part of the bars, the batch another, overlapping part.


def stored_and_batch(spark, folder):
    b = views.bars(spark, folder).select("ticker", "date", "close", "volume")
    old = b.where(F.col("volume") % 3 != 0)
    new = b.where(F.col("volume") % 3 != 1).select("ticker", "date", (F.col("close") * 2).alias("close"), "volume")
    return old, new


STORED = {
    "old": "SELECT ticker, date, close, volume FROM bars WHERE volume % 3 <> 0",
    "new": "SELECT ticker, date, close * 2 AS close, volume FROM bars WHERE volume % 3 <> 1",
}


@query("w1_upsert_bars", sql("""
SELECT * FROM (SELECT ticker, date, first(close ORDER BY close) AS close, first(volume ORDER BY close) AS volume
  FROM (SELECT * FROM new UNION ALL SELECT ticker, date, close + 1, volume FROM new) GROUP BY 1, 2)
UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.ticker = old.ticker AND new.date = old.date)""", "bars", **STORED))
def w1(spark, folder):
    old, new = stored_and_batch(spark, folder)
    again = new.withColumn("close", F.col("close") + 1)
    return merge.upsert_bars(old, new.unionByName(again), ["close"])


@query("w2_insert_new", sql("""
SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (ticker, date)""", "bars", **STORED))
def w2(spark, folder):
    old, new = stored_and_batch(spark, folder)
    return merge.insert_new(old, new, ["ticker", "date"])


@query("w3_upsert_tickers", sql("""
SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(n.name, o.name) AS name, o.type AS type, coalesce(n.sic_code, o.sic_code) AS sic_code
FROM (SELECT * FROM tickers WHERE id % 4 <> 0) o
FULL JOIN (SELECT ticker, CASE WHEN id % 3 = 0 THEN NULL ELSE upper(name) END AS name, sic_code + 1 AS sic_code FROM tickers WHERE id % 2 = 0) n USING (ticker)""", "tickers"))
def w3(spark, folder):
    t = views.tickers(spark, folder)
    old = t.where(F.col("id") % 4 != 0).select("ticker", "name", "type", "sic_code")
    new = t.where(F.col("id") % 2 == 0).select(
        "ticker", F.when(F.col("id") % 3 != 0, F.upper("name")).alias("name"), (F.col("sic_code") + 1).alias("sic_code"))
    return merge.upsert_tickers(old, new, ["name", "sic_code"])


@query("w5_upsert_dividends", sql("""
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.ticker_id ELSE n.ticker_id END AS ticker_id,
  CASE WHEN n.id IS NOT NULL THEN n.ex_dividend_date ELSE o.ex_dividend_date END AS ex_dividend_date,
  CASE WHEN n.id IS NOT NULL THEN n.cash_amount ELSE o.cash_amount END AS cash_amount
FROM (SELECT * FROM dividends WHERE id % 3 <> 0) o
FULL JOIN (SELECT id, ticker_id + 1000 AS ticker_id, CASE WHEN id % 5 > 0 THEN ex_dividend_date + 1 END AS ex_dividend_date,
  cash_amount * 2 AS cash_amount FROM dividends WHERE id % 3 <> 1) n ON o.id = n.id""", "dividends"))
def w5(spark, folder):
    d = views.dividends(spark, folder)
    new = d.where(F.col("id") % 3 != 1).select(
        "id", (F.col("ticker_id") + 1000).alias("ticker_id"),
        F.when(F.col("id") % 5 > 0, F.date_add("ex_dividend_date", 1)).alias("ex_dividend_date"),
        (F.col("cash_amount") * 2).alias("cash_amount"))
    return merge.upsert_dividends(d.where(F.col("id") % 3 != 0), new)


@query("w8_stamp_changes", sql("""
SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.date, n.date) AS date, coalesce(n.close, o.close) AS close,
  CASE WHEN n.ticker IS NULL OR (o.ticker IS NOT NULL AND n.close = o.close) THEN 'old' ELSE 'now' END AS stamp
FROM (SELECT * FROM bars WHERE volume % 3 <> 0) o
FULL JOIN (SELECT ticker, date, CASE WHEN volume % 2 = 0 THEN close ELSE close * 2 END AS close FROM bars WHERE volume % 3 <> 1) n
  ON o.ticker = n.ticker AND o.date = n.date""", "bars"))
def w8(spark, folder):
    b = views.bars(spark, folder).select("ticker", "date", "close", "volume")
    old = b.where(F.col("volume") % 3 != 0).select("ticker", "date", "close", F.lit("2000-01-01").cast("timestamp").alias("updated_at"))
    new = b.where(F.col("volume") % 3 != 1).select(
        "ticker", "date", F.when(F.col("volume") % 2 == 0, F.col("close")).otherwise(F.col("close") * 2).alias("close"))
    out = merge.stamp_changes(old, new, ["ticker", "date"], "2001-01-01")
    return out.select("ticker", "date", "close", F.when(F.year("updated_at") == 2000, "old").otherwise("now").alias("stamp"))


