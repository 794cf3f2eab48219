"""Queries: features, targets, dividends, storage and panel assembly."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.shared import fresh_path, materialise, spread
from ..operators import aggregates, dividends, features, merge, trend, validate
from ..sources import storage, views
from . import indicators as ind
from .common import near, query, rounded, shown
from .indicators import flag, lag, roll
from .views import sql

W = "PARTITION BY ticker ORDER BY date"
K = ["ticker", "date"]


def lead(x, h):
    return f"lead({x}, {h}) OVER ({W})"


def register(name, operator, columns, ctes=None, source="bars"):
    """columns: output -> (SQL expression, digits or None)."""
    text = ", ".join(f'{e} AS "{c}"' if d is None else f'{near(e, d)} AS "{c}"' for c, (e, d) in columns.items())

    @query(name, sql(f"SELECT ticker, date, {text} FROM {source}", "bars", **(ctes or {})))
    def run(spark, folder):
        return shown(operator(spread(views.bars(spark, folder))), K, {c: d for c, (_, d) in columns.items()})


BODY, UP, LOW = "abs(close - open)", "(high - greatest(close, open))", "(least(close, open) - low)"
CANDLE = {
    "Price_High_Low_Ratio": ("high / low", 6), "Price_Close_Open_Ratio": ("close / open", 6), "Price_Range": ("high - low", None),
    "Price_Range_Pct": ("(high - low) / close", 6), "Body_Size": (BODY, None), "Upper_Shadow": (UP, None),
    "Lower_Shadow": (LOW, None), "Body_Shadow_Ratio": (f"{BODY} / ({UP} + {LOW} + 1e-8)", 2),
}
register("f1_candles", features.candles, CANDLE)
RETURNS = {}
for _h in features.RETURN_HORIZONS:
    RETURNS |= {f"Return_{_h}D": (f"close / {lag('close', _h)} - 1", 6), f"Log_Return_{_h}D": (f"ln(close / {lag('close', _h)})", 6)}
register("f2_returns", features.returns, RETURNS)
VRATIO = {"Volume_Price_Ratio": ("volume / close", 7), "Volume_Range_Ratio": ("volume / nullif(high - low, 0)", 5)}
register("f3_volume_ratios", features.volume_ratios, VRATIO)
GAPS = {"Gap_Up": (flag(f"open > {lag('high')}"), None), "Gap_Down": (flag(f"open < {lag('low')}"), None), "Gap_Size": (f"open - {lag('close')}", None)}
register("f4_gaps", features.price_gaps, GAPS)
TARGETS = {"dayofweek": ("CAST(isodow(date) - 1 AS INTEGER)", None)}
for _h in (10, 20):
    TARGETS |= {f"Future_High_{_h}D": (lead("high", _h), None), f"Future_Close_{_h}D": (lead("close", _h), None), f"Target_Date_{_h}D": (lead("date", _h), None)}
register("f5_targets", features.targets, TARGETS)

# every indicator, feature and target of the panel next to each other.
FULL = ind.TREND | ind.MOMENTUM | ind.VOLATILITY | ind.VOLUME
FULL_CTES = ind.TREND_CTES | ind.MOMENTUM_CTES | ind.VOLATILITY_CTES | ind.VOLUME_CTES


def _select(columns, source):
    return "SELECT ticker, date, " + ", ".join(
        f'{e} AS "{c}"' if d is None else f'{near(e, d)} AS "{c}"' for c, (e, d) in columns.items()) + f" FROM {source}"


FULL_CTES = FULL_CTES | {
    "x1": _select(ind.TREND, "tj"), "x2": _select(ind.MOMENTUM, "mj"), "x3": _select(ind.VOLATILITY, "lj"),
    "x4": _select(ind.VOLUME, "uj"), "x5": _select(CANDLE | RETURNS | VRATIO | GAPS | TARGETS, "bars"),
}
ALL_COLUMNS = {c: d for part in (FULL, CANDLE, RETURNS, VRATIO, GAPS, TARGETS) for c, (_, d) in part.items()}


WHOLE = "SELECT * FROM x1 JOIN x2 USING (ticker, date) JOIN x3 USING (ticker, date) JOIN x4 USING (ticker, date) JOIN x5 USING (ticker, date)"


@query("f6_all_features", sql(WHOLE, "bars", **FULL_CTES))
def f6(spark, folder):
    return shown(features.all_features(views.bars(spark, folder)), K, ALL_COLUMNS)


@query("flagship_top10", sql(f"""
SELECT ticker, date, close, {near('sma', 5)} AS "SMA_20", {near('ret', 6)} AS "Return_1D", future AS "Future_Close_10D", rank_in_day FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret DESC, ticker) AS rank_in_day FROM (
    SELECT ticker, date, close, {roll('avg', 'close', 20)} AS sma, close / {lag('close')} - 1 AS ret, {lead('close', 10)} AS future
    FROM bars) WHERE ret IS NOT NULL) WHERE rank_in_day <= 10""", "bars"))
def flagship(spark, folder):
    """Valid bars -> average and return -> target -> the ten best returns per date."""
    from ..operators.evaluate import top_per_day

    ok = validate.split_valid(validate.check_bars(views.bars(spark, folder), "2100-01-01"))[0]
    panel = features.targets(features.returns(trend.sma(ok, (20,)), (1,)), (10,)).where(F.col("Return_1D").isNotNull())
    out = top_per_day(panel, "Return_1D", 10, ties=["ticker"])
    return shown(out, [*K, "close", "Future_Close_10D", "rank_in_day"], {"SMA_20": 5, "Return_1D": 6})


# Dividends ---------------------------------------------------------------------------


def paid(spark, folder):
    t = views.tickers(spark, folder).select(F.col("id").alias("ticker_id"), "ticker")
    return views.dividends(spark, folder).join(t, "ticker_id")


EVENTS = "SELECT t.ticker, d.ex_dividend_date, sum(d.cash_amount) AS amount FROM dividends d JOIN tickers t ON t.id = d.ticker_id GROUP BY 1, 2"
MAPPED = """SELECT ticker, ex_dividend_date, amount, date FROM (
  SELECT e.*, b.date, row_number() OVER (PARTITION BY e.ticker, e.ex_dividend_date ORDER BY abs(b.date - e.ex_dividend_date), b.date) AS rn
  FROM events_by_ticker e JOIN bars b ON b.ticker = e.ticker AND b.date BETWEEN e.ex_dividend_date - 3 AND e.ex_dividend_date + 3) WHERE rn = 1"""
DIV_VIEWS = ("bars", "tickers", "dividends")


@query("j3_nearest_date_join", sql("SELECT ticker, ex_dividend_date, date FROM mapped", *DIV_VIEWS, events_by_ticker=EVENTS, mapped=MAPPED))
def j3(spark, folder):
    ev = paid(spark, folder).select("ticker", "ex_dividend_date").distinct()
    return dividends.map_to_bars(views.bars(spark, folder), ev)


@query("j4_previous_next_event", sql(f"""
SELECT ticker, date, CAST(date - max(ev) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS days_since_last_dividend,
  CAST(min(ev) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - date AS INTEGER) AS days_to_next_dividend
FROM (SELECT ticker, date, CASE WHEN volume % 7 = 0 THEN date END AS ev FROM bars)""", "bars"))
def j4(spark, folder):
    b = views.bars(spark, folder).select("ticker", "date", (F.col("volume") % 7 == 0).cast("int").alias("ev"))
    return dividends.event_distance(b, "ev").drop("ev")


DIVF = f"""SELECT b.ticker, b.date, amount AS dividend_amount, amount / close AS dividend_yield,
  CAST(amount IS NOT NULL AS INTEGER) AS is_ex_dividend,
  CAST(b.date - max(CASE WHEN amount IS NOT NULL THEN b.date END) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS days_since_last_dividend,
  CAST(min(CASE WHEN amount IS NOT NULL THEN b.date END) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - b.date AS INTEGER) AS days_to_next_dividend
FROM bars b LEFT JOIN (SELECT ticker, date, last(amount ORDER BY ex_dividend_date) AS amount FROM mapped GROUP BY 1, 2) m ON m.ticker = b.ticker AND m.date = b.date"""
DIV_DIGITS = {"dividend_amount": 5, "dividend_yield": 8, "is_ex_dividend": None, "days_since_last_dividend": None, "days_to_next_dividend": None}


@query("f7_dividend_features", sql(f"""SELECT ticker, date, {near('dividend_amount', 5)} AS dividend_amount, {near('dividend_yield', 8)} AS dividend_yield,
  is_ex_dividend, days_since_last_dividend, days_to_next_dividend FROM divf""", *DIV_VIEWS, events_by_ticker=EVENTS, mapped=MAPPED, divf=DIVF))
def f7(spark, folder):
    return shown(dividends.dividend_features(views.bars(spark, folder), paid(spark, folder)), K, DIV_DIGITS)


@query("j5_features_with_dividends", sql(f"""SELECT b.ticker, b.date, b.close, {near('dividend_amount', 5)} AS dividend_amount,
  CASE WHEN b.volume % 2 = 0 THEN 9 ELSE d.is_ex_dividend END AS is_ex_dividend FROM bars b JOIN divf d USING (ticker, date)""",
    *DIV_VIEWS, events_by_ticker=EVENTS, mapped=MAPPED, divf=DIVF))
def j5(spark, folder):
    b = views.bars(spark, folder)
    left = b.select("ticker", "date", "close", F.when(F.col("volume") % 2 == 0, 9).alias("is_ex_dividend"))
    out = dividends.with_dividends(left, dividends.dividend_features(b, paid(spark, folder)))
    return shown(out, [*K, "close", "is_ex_dividend"], {"dividend_amount": 5})


# Vendor dividend records derived from orders, with missing, empty, zero and bad fields.
RAW_DIV = """SELECT CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS id,
  CASE WHEN k % 11 = 0 AND k % 2 = 0 THEN 'd' || CAST(k AS VARCHAR) END AS dividend_id, 1 + o_custkey % 50 AS ticker_id,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 17 = 0 THEN 'abc' WHEN k % 19 = 0 THEN '0' ELSE CAST(k % 1000 AS VARCHAR) || '.25' END AS cash_amount,
  CASE WHEN k % 14 = 0 THEN CAST(k % 10 + 1 AS VARCHAR) END AS amount,
  CASE WHEN k % 23 = 0 THEN 'USDX' WHEN k % 29 = 0 THEN '' ELSE 'USD' END AS currency,
  CASE WHEN k % 31 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ex_dividend_date, 'CD' AS type, k
FROM (SELECT *, o_orderkey AS k FROM orders)"""


def raw_dividends(spark, folder):
    k = F.col("o_orderkey")
    s = k.cast("string")
    return views.table(spark, folder, "orders").select(
        F.when(k % 11 == 0, None).when(k % 13 == 0, "").otherwise(s).alias("id"),
        F.when((k % 11 == 0) & (k % 2 == 0), F.concat(F.lit("d"), s)).alias("dividend_id"),
        (F.col("o_custkey") % 50 + 1).alias("ticker_id"),
        F.when(k % 7 == 0, None).when(k % 17 == 0, "abc").when(k % 19 == 0, "0")
        .otherwise(F.concat((k % 1000).cast("string"), F.lit(".25"))).alias("cash_amount"),
        F.when(k % 14 == 0, (k % 10 + 1).cast("string")).alias("amount"),
        F.when(k % 23 == 0, "USDX").when(k % 29 == 0, "").otherwise("USD").alias("currency"),
        F.when(k % 31 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ex_dividend_date"),
        F.lit("CD").alias("type"), F.lit("4").alias("frequency"),
    )


TYPED_DIV = """SELECT *, CASE WHEN key IS NULL THEN 'missing_id' WHEN amt IS NULL THEN 'missing_cash_amount'
    WHEN TRY_CAST(amt AS DECIMAL(18,6)) IS NULL THEN 'invalid_cash_amount'
    WHEN currency <> '' AND length(currency) <> 3 THEN 'invalid_currency' END AS reason
  FROM (SELECT *, coalesce(nullif(id, ''), nullif(dividend_id, '')) AS key,
    coalesce(CASE WHEN cash_amount <> '0' THEN cash_amount END, amount) AS amt FROM raw_div)"""


@query("b13_dividend_records", sql("""SELECT key AS id, ticker_id, CAST(TRY_CAST(amt AS DECIMAL(18,6)) AS DOUBLE) AS cash_amount, currency,
  TRY_CAST(ex_dividend_date AS DATE) AS ex_dividend_date, type AS dividend_type FROM typed_div WHERE reason IS NULL""", raw_div=RAW_DIV, typed_div=TYPED_DIV))
def b13(spark, folder):
    out = dividends.accepted(dividends.transform_records(raw_dividends(spark, folder)))
    return out.select("id", "ticker_id", F.col("cash_amount").cast("double").alias("cash_amount"), "currency", "ex_dividend_date", "dividend_type")


@query("s28_rejected_dividends", sql("SELECT reason, count(*) AS records FROM typed_div WHERE reason IS NOT NULL GROUP BY 1", raw_div=RAW_DIV, typed_div=TYPED_DIV))
def s28(spark, folder):
    """Quarantine written out, then read back and counted."""
    path = fresh_path(spark, "rejected-dividends")
    dividends.rejected(dividends.transform_records(raw_dividends(spark, folder))).write.json(path)
    return spark.read.schema("reason string, payload string").json(path).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


# Derived features --------------------------------------------------------------------

register("f8_price_normalised", lambda b: features.price_normalised(ind.volatility.atr(ind.volatility.bollinger(trend.ichimoku(features.returns(trend.sma(b, (5, 20)), (1,)))))), {
    "SMA_5_Ratio": (f"close / {roll('avg', 'close', 5)}", 6), "SMA_20_Ratio": (f"close / {roll('avg', 'close', 20)}", 6),
    "BB_Position": ("bp", 6), "Price_ATR_Ratio": ("close / nullif(av, 0)", 5),
    "Return_Volume_Efficiency": (f"abs(close / {lag('close')} - 1) / (volume + 1e-8)", 7),
    "Ichimoku_Tenkan_Ratio": ("close / tk", 6), "Ichimoku_Kijun_Ratio": ("close / kj", 6), "Ichimoku_Senkou_A_Ratio": ("close / sa", 6),
    "Ichimoku_Senkou_B_Ratio": ("close / sb", 6), "Ichimoku_Chikou_Ratio": ("close / ck", 6), "Close_Open_Ratio": ("close / open", 6),
}, ind.BB_CTES | ind.ATR_CTES | ind.ICHI_CTES | {"f8": "SELECT i2.*, bp, av FROM i2 JOIN b4 USING (ticker, date) JOIN a4 USING (ticker, date)"}, "f8")

register("f9_prediction_bounds", lambda b: features.prediction_bounds(ind.volatility.volatility_regime(ind.volatility.return_volatility(ind.volatility.atr(ind.momentum.rsi(b))))), {
    "Expected_Daily_Move": ("100 * av / close", 5), "Expected_10D_Move": ("100 * av / close * sqrt(10)", 5),
    "Vol_Regime_Context": (f"{flag('sd10 > q8')} * 2 + {flag('sd10 < q2')} * 0.5::DOUBLE", 2),
    "RSI_Mean_Reversion_Pressure": ("abs(rsi14 - 50) / 50", 6),
}, ind.RSI_CTES | ind.ATR_CTES | ind.VOL_CTES | {"f9": "SELECT v3.*, av, rsi14 FROM v3 JOIN a4 USING (ticker, date) JOIN r2 USING (ticker, date)"}, "f9")


@query("f10_calendar", """
SELECT o_orderkey, CAST(d - DATE '2020-01-01' AS INTEGER) AS date_int, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
  CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week,
  CAST(last_day(d) = d AS INTEGER) AS is_month_end, CAST(last_day(d) = d AND month(d) % 3 = 0 AS INTEGER) AS is_quarter_end
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def f10(spark, folder):
    d = views.table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return features.calendar(d).drop("date")


TARGET = f"SELECT *, {lead('close', 10)} / close - 1 AS ret FROM bars"
KEPT = "(ret IS NULL OR ret BETWEEN -0.7 - 1e-9 AND 1 + 1e-9)"


@query("f11_return_target", sql(f'SELECT ticker, date, {near("ret", 6)} AS "Future_Return_10D" FROM tg WHERE {KEPT}', "bars", tg=TARGET))
def f11(spark, folder):
    out, name = features.return_target(features.targets(views.bars(spark, folder)), 10)
    return shown(out, K, {name: 6})


REACH = repr(10.0 * math.sqrt(10) / 100)


@query("f12_return_to_price", sql(f"""SELECT id, {near('current_price * (1 + y_pred)', 5)} AS predicted_price,
  {near(f'least(greatest(current_price * (1 + y_pred * 5), current_price * (1 - {REACH})), current_price * (1 + {REACH}))', 5)} AS bounded_price FROM scored""", "scored"))
def f12(spark, folder):
    s = views.scored(spark, folder)
    p, c = F.col("y_pred"), F.col("current_price")
    out = s.select("id", features.to_price(p, c).alias("predicted_price"), features.to_price(p * 5, c, bounded=True).alias("bounded_price"))
    return shown(out, ["id"], {"predicted_price": 5, "bounded_price": 5})


LONG = ("SMA_5", "OBV_SMA_10", "Return_1D", "BB_Width", "Volume_MA_10", "ROC_10")
LONG_CTES = FULL_CTES | {"fx": WHOLE}
LONG_SQL = " UNION ALL ".join(
    f"SELECT ticker, date, '{c}' AS feature_name, CAST(\"{c}\" AS DOUBLE) AS v, '{validate.category_of(c)}' AS feature_category FROM fx" for c in LONG)


def long_input(spark, folder):
    """One column per category of the whole panel; what the others need is pruned."""
    return shown(features.all_features(views.bars(spark, folder)), K, {c: ALL_COLUMNS[c] for c in LONG})


@query("f13_long_features", sql(f"SELECT ticker, date, feature_name, feature_category, {near('v', 5)} AS feature_value FROM ({LONG_SQL}) WHERE abs(v) < 1e9", "bars", **LONG_CTES))
def f13(spark, folder):
    return shown(features.long_features(long_input(spark, folder), list(LONG)), [*K, "feature_name", "feature_category"], {"feature_value": 5})


@query("f14_feature_batch", sql(f"""SELECT * FROM ({WHOLE}) WHERE ticker IN (
  SELECT t.ticker FROM tickers t JOIN bars USING (ticker) WHERE t.active AND t.type = 'CS' GROUP BY 1 HAVING count(*) >= 285)""", "bars", "tickers", **FULL_CTES))
def f14(spark, folder):
    return shown(features.feature_batch(views.bars(spark, folder), views.tickers(spark, folder), 285), K, ALL_COLUMNS)


@query("f14_batch_results", sql("""SELECT ticker, count(*) AS records, CASE WHEN count(*) >= 290 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN count(*) < 290 THEN 'insufficient_data' END AS error FROM bars GROUP BY 1""", "bars"))
def f14b(spark, folder):
    return features.batch_results(views.bars(spark, folder), 290)


@query("a13_run_statistics", sql("""SELECT count(*) AS processed, count(*) FILTER (n >= 290) AS successful, count(*) FILTER (n < 290) AS failed,
  round(100.0 * count(*) FILTER (n >= 290) / count(*), 4) AS success_rate, CAST(sum(n) AS BIGINT) AS records FROM (SELECT ticker, count(*) AS n FROM bars GROUP BY 1)""", "bars"))
def a13(spark, folder):
    out = aggregates.run_statistics(features.batch_results(views.bars(spark, folder), 290))
    return out.withColumn("success_rate", F.round("success_rate", 4))


# Quality of computed features --------------------------------------------------------

#: Every numeric column of the panel.
QCOLS = [c for c in ALL_COLUMNS if not c.startswith("Target_Date_")]
Q_CTE = FULL_CTES | {"qf": WHOLE}
Q_MISSING = " + ".join(f'count(*) - count("{c}")' for c in QCOLS)
Q_SCORE = f"100 * (1 - ({Q_MISSING}) / (count(*) * {len(QCOLS)}.0::DOUBLE))"


def quality_panel(spark, folder):
    return features.all_features(spread(views.bars(spark, folder))).select(*K, *QCOLS)


def quality_input(spark, folder):
    return shown(quality_panel(spark, folder), K, {c: ALL_COLUMNS[c] for c in QCOLS})


@query("v11_valid_results", sql(f"""SELECT ticker, date FROM qf WHERE ticker IN (
  SELECT ticker FROM qf GROUP BY 1 HAVING {Q_SCORE} >= 95.6)""", "bars", **Q_CTE))
def v11(spark, folder):
    # Rounding makes no value missing or infinite.
    return validate.valid_results(quality_panel(spark, folder), QCOLS, 95.6).select(*K)


@query("v12_category_quality", sql(f"""SELECT ticker, {near(Q_SCORE, 5)} AS quality_score, 0 AS has_infinite
FROM qf GROUP BY 1""", "bars", **Q_CTE))
def v12(spark, folder):
    return shown(validate.category_quality(quality_panel(spark, folder), QCOLS), ["ticker", "has_infinite"], {"quality_score": 5})


Q_LONG = "SELECT ticker, unnest([" + ", ".join(f"'{c}'" for c in QCOLS) + "]) AS f, unnest([" + ", ".join(f'"{c}"::DOUBLE' for c in QCOLS) + "]) AS v FROM qf"


@query("v13_overall_quality", sql(f"""
SELECT ticker, {near('100.0::DOUBLE * (sum(present) / sum(n)) * (1 - least(coalesce(sum(outliers) / nullif(sum(tested), 0), 0), 0.5))', 4)} AS quality_score FROM (
  SELECT ticker, f, count(*) AS n, count(v) AS present, CASE WHEN count(v) > 10 THEN count(v) ELSE 0 END AS tested,
    CASE WHEN count(v) > 10 THEN count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) ELSE 0 END AS outliers
  FROM ql JOIN (SELECT ticker, f, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM ql GROUP BY 1, 2) USING (ticker, f)
  GROUP BY 1, 2) GROUP BY 1""", "bars", once=True, **Q_CTE, ql=Q_LONG))
def v13(spark, folder):
    return shown(validate.overall_quality(quality_input(spark, folder), QCOLS), ["ticker"], {"quality_score": 4})


@query("v16_category_columns", sql("SELECT ticker, date, \"SMA_5\", \"OBV_SMA_10\" FROM fx", "bars", **LONG_CTES))
def v16(spark, folder):
    chosen = validate.columns_in(list(LONG), ["trend"])
    return long_input(spark, folder).select(*K, *chosen)


@query("v17_checked_settings", sql("SELECT ticker FROM bars GROUP BY 1 HAVING count(*) >= 280", "bars"))
def v17(spark, folder):
    validate.check_settings(batch_size=1, min_points=280, missing=(0.05,), ordered=[(50, 280)])
    return validate.enough_data(views.bars(spark, folder), 280).select("ticker").distinct()


# Storage -----------------------------------------------------------------------------


def small_panel(spark, folder):
    b = features.targets(features.returns(trend.sma(views.bars(spark, folder), (5,)), (1,)), (10,))
    return b.select(*K, "close", "volume", "SMA_5", "Return_1D", "Future_Close_10D")


SMALL = {"sp": f"""SELECT ticker, date, close, volume, {roll('avg', 'close', 5)} AS sma5, close / {lag('close')} - 1 AS r1, {lead('close', 10)} AS fc FROM bars"""}


@query("s14_write_features", sql("SELECT version, count(*) AS rows, count(DISTINCT ticker) AS tickers, CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT 'v1' AS version, * FROM bars UNION ALL SELECT 'v2', * FROM bars WHERE volume > 20) GROUP BY 1", "bars"))
def s14(spark, folder):
    path = fresh_path(spark, "features")
    panel = small_panel(spark, folder)
    storage.write_features(panel, path, "v1")
    storage.write_features(panel.where(F.col("volume") > 20), path, "v2")
    return spark.read.parquet(path).groupBy("version").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"), F.sum("volume").alias("volume"))


@query("s15_read_features", sql(f"""SELECT ticker, date, {near('sma5', 5)} AS "SMA_5" FROM sp WHERE ticker = 'T000007' AND date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""", "bars", **SMALL))
def s15(spark, folder):
    path = fresh_path(spark, "features")
    storage.write_features(small_panel(spark, folder), path, "v1")
    out = storage.read_features(spark, path, "T000007", "1998-01-01", "1998-12-31", ["trend"], "v1")
    return shown(out, K, {"SMA_5": 5})


@query("s16_feature_metadata", sql(f"""SELECT ticker, 'v1' AS feature_version, min(date) AS start_date, max(date) AS end_date, count(*) AS record_count, 5 AS total_features,
  {near('100.0::DOUBLE * (1 - (5 * count(*) - count(close) - count(volume) - count(sma5) - count(r1) - count(fc)) / (5.0::DOUBLE * count(*)))', 5)} AS quality_score FROM sp GROUP BY 1""", "bars", **SMALL))
def s16(spark, folder):
    path = fresh_path(spark, "metadata")
    storage.write_metadata(storage.feature_metadata(small_panel(spark, folder), "v1"), path)
    return shown(spark.read.parquet(path), ["ticker", "feature_version", "start_date", "end_date", "record_count", "total_features"], {"quality_score": 5})


@query("s17_storage_statistics", sql("SELECT 'v1' AS version, count(*) AS rows, count(DISTINCT ticker) AS tickers, 1 AS has_files FROM bars", "bars"))
def s17(spark, folder):
    path = fresh_path(spark, "features")
    storage.write_features(small_panel(spark, folder), path, "v1")
    out = storage.storage_statistics(spark, path)
    return out.select("version", "rows", "tickers", ((F.col("files") > 0) & (F.col("bytes") > 0)).cast("int").alias("has_files"))


@query("s18_keep_newest_versions", sql("SELECT v AS version, count(*) AS rows FROM bars CROSS JOIN (VALUES ('v2'), ('v3')) t(v) GROUP BY 1", "bars"))
def s18(spark, folder):
    """Three versions are written; after keeping the newest two, the rest is still readable."""
    path = fresh_path(spark, "features")
    for v in ("v1", "v2", "v3"):
        storage.write_features(small_panel(spark, folder), path, v)
    storage.drop_versions(spark, path, keep=2)
    return spark.read.parquet(path).groupBy("version").agg(F.count(F.lit(1)).alias("rows"))


@query("s19_consolidate_by_year", sql("SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT ticker) AS tickers FROM bars GROUP BY 1", "bars"))
def s19(spark, folder):
    path = fresh_path(spark, "consolidated")
    storage.consolidate(small_panel(spark, folder), path)
    return storage.consolidation_report(spark, path).select("year", "rows", "tickers")


@query("s20_read_consolidated", sql(f"""SELECT ticker, date, {near('sma5', 5)} AS "SMA_5" FROM sp WHERE date BETWEEN DATE '1997-06-01' AND DATE '1998-03-31'""", "bars", **SMALL))
def s20(spark, folder):
    path = fresh_path(spark, "consolidated")
    storage.consolidate(small_panel(spark, folder), path)
    return shown(storage.read_consolidated(spark, path, start="1997-06-01", end="1998-03-31", categories=["trend"]), K, {"SMA_5": 5})


@query("s21_features_with_metadata", sql("""SELECT ticker, date, close, record_count, start_date FROM sp
JOIN (SELECT ticker, count(*) AS record_count, min(date) AS start_date FROM sp GROUP BY 1) USING (ticker)""", "bars", **SMALL))
def s21(spark, folder):
    panel = small_panel(spark, folder)
    return storage.with_metadata(panel, storage.feature_metadata(panel, "v1")).select(*K, "close", "record_count", "start_date")


@query("s22_load_years", sql("""SELECT b.ticker, b.date, b.close, CAST(year(b.date) AS INTEGER) AS data_year, t.id AS ticker_id
FROM bars b LEFT JOIN tickers t USING (ticker) WHERE year(b.date) IN (1997, 1999)""", "bars", "tickers"))
def s22(spark, folder):
    return storage.load_years(small_panel(spark, folder), views.tickers(spark, folder), (1997, 1999)).select(*K, "close", "data_year", "ticker_id")


@query("s23_features_and_target", sql(f'SELECT ticker, date, close, {near("r1", 6)} AS "Return_1D", fc AS "Future_Close_10D" FROM sp WHERE fc IS NOT NULL', "bars", **SMALL))
def s23(spark, folder):
    out, target = storage.features_and_target(small_panel(spark, folder), 10)
    return shown(out, [*K, "close", target], {"Return_1D": 6})


@query("s24_prepared_cache", sql("SELECT ticker, date, close, volume FROM bars", "bars"))
def s24(spark, folder):
    place = fresh_path(spark, "cache")
    build = lambda: small_panel(spark, folder)
    storage.cached(spark, place, build, horizon=10, data=folder)
    return storage.cached(spark, place, build, horizon=10, data=folder).select(*K, "close", "volume")


@query("s26_stable_sample", sql("""SELECT ticker, date, close, volume FROM bars ORDER BY md5('42|' || ticker || '|' || CAST(date AS VARCHAR)), ticker, date LIMIT 1000""", "bars"))
def s26(spark, folder):
    path = fresh_path(spark, "sample")
    storage.export_csv(storage.stable_sample(views.bars(spark, folder).select(*K, "close", "volume"), K, 1000), path)
    return spark.read.option("header", "true").schema("ticker string, date date, close double, volume long").csv(path)


# Dimension maps and category tables --------------------------------------------------


@query("j8_dimension_map", sql("""SELECT s.id, coalesce(t.ticker, CAST(s.ticker_id AS VARCHAR)) AS ticker, coalesce(t.name, 'Unknown') AS company_name
FROM scored s LEFT JOIN tickers t ON t.id = s.ticker_id""", "scored", "tickers"))
def j8(spark, folder):
    from ..operators.evaluate import with_company

    return with_company(views.scored(spark, folder), views.tickers(spark, folder)).select("id", "ticker", "company_name")


#: Table of a category: its columns, and the column without which it has no row.
CATEGORY_TABLES = {
    "trend": (ind.TREND, "SMA_50"), "momentum": (ind.MOMENTUM, "Stoch_D"), "volatility": (ind.VOLATILITY, "Volatility_Std_10"),
    "volume": (ind.VOLUME, "VPT_Momentum_5"),
}
COUNTS = {c: len(columns) for c, (columns, _) in CATEGORY_TABLES.items()}
CT = FULL_CTES | {
    f"c_{c}": f"""SELECT *, {near(f"100 * ({' + '.join(f'(\"{x}\" IS NOT NULL)::INT' for x in columns)}) / {len(columns)}.0::DOUBLE", 5)} AS quality_score,
      date + {i} AS created_at FROM x{i + 1} WHERE "{key}" IS NOT NULL"""
    for i, (c, (columns, key)) in enumerate(CATEGORY_TABLES.items())
}
JOINED = "c_trend t FULL JOIN c_momentum m USING (ticker, date) FULL JOIN c_volatility v USING (ticker, date) FULL JOIN c_volume u USING (ticker, date)"


def category_tables(spark, folder):
    """The four indicator tables, each with a score and a time per row; the first rows of a ticker are missing to different lengths."""
    # Four panels read the bars, so they are written once.
    b = spread(materialise(views.bars(spark, folder), "category-bars"))
    out = {}
    builders = (trend.trend, ind.momentum.momentum, ind.volatility.volatility, ind.volume.volume)
    for i, ((c, (columns, key)), build) in enumerate(zip(CATEGORY_TABLES.items(), builders)):
        table = shown(build(b), K, {x: d for x, (_, d) in columns.items()}).where(F.col(key).isNotNull())
        filled = sum((F.col(x).isNotNull().cast("int") for x in columns), F.lit(0))
        out[c] = table.withColumns({"quality_score": rounded(100 * filled / float(len(columns)), 5), "created_at": F.date_add("date", i)})
    return out


@query("j9_unified_features", sql(f"""SELECT ticker, date, t.* EXCLUDE (ticker, date, quality_score, created_at), m.* EXCLUDE (ticker, date, quality_score, created_at),
  v.* EXCLUDE (ticker, date, quality_score, created_at), u.* EXCLUDE (ticker, date, quality_score, created_at),
  greatest(t.created_at, m.created_at, v.created_at, u.created_at) AS last_updated FROM {JOINED}""", "bars", once=True, **CT))
def j9(spark, folder):
    from ..operators.joins import unify_categories

    out = unify_categories(category_tables(spark, folder))
    return out.drop(*[f"{c}_quality" for c in CATEGORY_TABLES])


@query("a10_feature_summary", sql(f"""SELECT ticker, date, {', '.join(f"CASE WHEN {a}.created_at IS NOT NULL THEN {COUNTS[c]} ELSE 0 END AS {c}_features" for a, c in zip('tmvu', COUNTS))},
  {' + '.join(f"CASE WHEN {a}.created_at IS NOT NULL THEN {COUNTS[c]} ELSE 0 END" for a, c in zip('tmvu', COUNTS))} AS total_features,
  {near('list_avg([x for x in [t.quality_score, m.quality_score, v.quality_score, u.quality_score] if x IS NOT NULL])', 5)} AS avg_quality_score
FROM {JOINED}""", "bars", once=True, **CT))
def a10(spark, folder):
    from ..operators.joins import feature_summary

    out = feature_summary(category_tables(spark, folder), COUNTS)
    keys = [*K, *[f"{c}_features" for c in COUNTS], "total_features"]
    return shown(out, keys, {"avg_quality_score": 5})


W7 = LONG_CTES | {
    "lf": f"SELECT ticker, date, feature_name, feature_category, v FROM ({LONG_SQL}) WHERE abs(v) < 1e9",
    "lo": "SELECT * FROM lf WHERE (dayofyear(date) % 3) <> 0", "ln": "SELECT * REPLACE (v * 2 AS v) FROM lf WHERE (dayofyear(date) % 3) <> 1",
}


@query("w7_upsert_long_features", sql(f"""SELECT ticker, date, feature_name, feature_category, {near('coalesce(n.v, o.v)', 4)} AS overwritten,
  {near('coalesce(o.v, n.v)', 4)} AS ignored FROM lo o FULL JOIN ln n USING (ticker, date, feature_name, feature_category)""", "bars", once=True, **W7))
def w7(spark, folder):
    keys = [*K, "feature_category", "feature_name"]
    # Both sides of both upserts read the panel, so it is written once.
    long = features.long_features(materialise(long_input(spark, folder), "long-input"), list(LONG))
    old = long.where(F.dayofyear("date") % 3 != 0)
    new = long.where(F.dayofyear("date") % 3 != 1).withColumn("feature_value", F.col("feature_value") * 2)
    over = merge.replace_rows(old, new, keys).withColumnRenamed("feature_value", "overwritten")
    kept = merge.insert_new(old, new, keys).withColumnRenamed("feature_value", "ignored")
    return shown(over.join(kept, keys), keys, {"overwritten": 4, "ignored": 4})


