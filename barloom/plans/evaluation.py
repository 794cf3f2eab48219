"""Queries: confidence, threshold sweep, metrics, selection and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import fresh_path
from ..operators import evaluate as ev
from ..sources import storage, views
from .common import near, query, shown
from .views import sql


def scaled(expr):
    return f"""SELECT id, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 0.5 END AS c
FROM (SELECT id, {expr} AS s FROM scored)"""


def confidence(name, fn, text):
    @query(name, sql(f"SELECT id, {near('c', 7)} AS confidence FROM ({text})", "scored"))
    def run(spark, folder):
        return shown(fn(views.scored(spark, folder).drop("confidence")), ["id"], {"confidence": 7})


confidence("e3_confidence_margin", ev.confidence_margin, scaled("abs(y_pred)"))
confidence("e3_confidence_simple", ev.confidence_simple,
           scaled("least(greatest(abs(y_pred - current_price) / nullif(current_price, 0), 0), 1)"))
confidence("e5_confidence_tanh", ev.confidence_tanh, "SELECT id, tanh(abs(y_pred)) AS c FROM scored")
confidence("e5_confidence_over_max", ev.confidence_over_max, "SELECT id, abs(y_pred / max(y_pred) OVER ()) AS c FROM scored")
confidence("e5_confidence_from_mean", ev.confidence_from_mean, "SELECT id, abs(y_pred - avg(y_pred) OVER ()) AS c FROM scored")

TREES = "[y_pred, y_pred * 2, y_pred - 0.01, y_true, y_pred + y_true]"


def with_trees(d):
    """Five single-tree predictions per row, as a model with leaf output would give."""
    p, t = F.col("y_pred"), F.col("y_true")
    return d.withColumns({
        "tree_predictions": F.array(p, p * 2, p - 0.01, t, p + t),
        "leaves": F.array(*[(F.col("id") * k % 17).cast("double") for k in (1, 3, 5, 7)]),
    })


confidence("e4_confidence_variance", lambda d: ev.confidence_variance(with_trees(d)),
           scaled(f"1.0 / (1 + list_aggregate({TREES}, 'var_pop'))"))
confidence("e4_confidence_leaf_depth", lambda d: ev.confidence_leaf_depth(with_trees(d)),
           scaled("pow((id * 1 % 17 + id * 3 % 17 + id * 5 % 17 + id * 7 % 17) / 4.0::DOUBLE, 2)"))

UP, HIT = "y_pred > 0", "(y_true > 0 AND y_true <= y_pred)"
GRID = ", ".join(repr(t) for t in ev.thresholds_between())
SWEEP = f"""SELECT t AS threshold, count(*) AS n, sum(CASE WHEN {UP} THEN 100 * y_true ELSE 0 END) AS p, count(*) FILTER ({UP}) AS inv,
    count(*) FILTER ({UP} AND {HIT}) AS ok, avg(confidence) AS conf, (SELECT count(*) FROM scored) AS total
  FROM (SELECT unnest([{GRID}]::DOUBLE[]) AS t) g JOIN scored ON confidence >= t GROUP BY 1"""
SWEPT = "SELECT * FROM sw WHERE n BETWEEN greatest(1, floor(total * 0.002)) AND floor(total * 0.3)"


@query("e6_threshold_sweep", sql(f"""
SELECT threshold, n AS test_samples_kept, {near('n / total', 7)} AS test_samples_ratio, {near('p', 5)} AS test_profit,
  {near('coalesce(ok / nullif(inv, 0), 0)', 7)} AS test_custom_accuracy, {near('p / n', 6)} AS test_profit_per_investment,
  {near('coalesce(ok / nullif(inv, 0), 0)', 7)} AS investment_success_rate, ok AS profitable_investments, {near('conf', 7)} AS average_confidence
FROM kept""", "scored", sw=SWEEP, kept=SWEPT))
def e6(spark, folder):
    return shown(ev.sweep(views.scored(spark, folder)), ["threshold", "test_samples_kept", "profitable_investments"], {
        "test_samples_ratio": 7, "test_profit": 5, "test_custom_accuracy": 7, "test_profit_per_investment": 6,
        "investment_success_rate": 7, "average_confidence": 7})


UNEVEN = [0.9, 0.71, 0.705, 0.86, 0.93, 0.999, 0.75, 0.9]


@query("e6_sweep_uneven_grid", sql(f"""
SELECT t AS threshold, count(*) AS test_samples_kept, {near('avg(confidence)', 7)} AS average_confidence
FROM (SELECT DISTINCT unnest({UNEVEN}::DOUBLE[]) AS t) g JOIN scored ON confidence >= t AND id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 GROUP BY 1""", "scored"))
def e6_uneven(spark, folder):
    """A grid in no order, over confidence with gaps, NaN and infinity, which pass nothing."""
    df = views.scored(spark, folder)
    c = F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 == 0, float("inf")).when(F.col("id") % 17 != 0, F.col("confidence"))
    swept = ev.sweep(df.withColumn("confidence", c), UNEVEN, min_share=0.0, max_share=1.0)
    return shown(swept, ["threshold", "test_samples_kept"], {"average_confidence": 7})


@query("e7_profit", sql(f"SELECT id, {near(f'CASE WHEN {UP} THEN 100 * y_true ELSE 0 END', 6)} AS profit FROM scored", "scored"))
def e7(spark, folder):
    return shown(ev.add_profit(views.scored(spark, folder)), ["id"], {"profit": 6})


@query("e8_conservative_accuracy", sql(f"""SELECT date, {near(f'coalesce(count(*) FILTER ({UP} AND {HIT}) / nullif(count(*) FILTER ({UP}), 0), 0)', 7)} AS accuracy FROM scored GROUP BY 1""", "scored"))
def e8(spark, folder):
    return shown(views.scored(spark, folder).groupBy("date").agg(ev.conservative_accuracy().alias("accuracy")), ["date"], {"accuracy": 7})


@query("e9_investment_metrics", sql(f"""SELECT date, count(*) FILTER ({UP}) AS investments_made, {near(f'count(*) FILTER ({UP}) / count(*)', 7)} AS investment_rate,
  {near(f'coalesce(count(*) FILTER ({UP} AND {HIT}) / nullif(count(*) FILTER ({UP}), 0), 0)', 7)} AS investment_success_rate,
  count(*) FILTER ({UP} AND {HIT}) AS profitable_investments, count(*) AS total_samples FROM scored GROUP BY 1""", "scored"))
def e9(spark, folder):
    out = ev.investment_metrics(views.scored(spark, folder), ["date"])
    return shown(out, ["date", "investments_made", "profitable_investments", "total_samples"], {"investment_rate": 7, "investment_success_rate": 7})


@query("e10_predict_with_threshold", sql("SELECT id, y_pred, confidence FROM scored WHERE confidence >= 0.7", "scored"))
def e10(spark, folder):
    return ev.predict_with_threshold(views.scored(spark, folder), 0.7).select("id", "y_pred", "confidence")


EVAL = f"""SELECT count(*) FILTER (ok) AS samples_evaluated, count(*) AS total_test_samples, {near('count(*) FILTER (ok) / count(*)', 7)} AS samples_kept_ratio,
  {near('avg(confidence) FILTER (ok)', 7)} AS average_confidence, {near('avg(pow(y_true - y_pred, 2)) FILTER (ok)', 8)} AS mse,
  {near('avg(abs(y_true - y_pred)) FILTER (ok)', 8)} AS mae,
  {near('1 - sum(pow(y_true - y_pred, 2)) FILTER (ok) / (var_pop(y_true) FILTER (ok) * count(*) FILTER (ok))', 6)} AS r2_score,
  {near(f'sum(CASE WHEN {UP} THEN 100 * y_true ELSE 0 END) FILTER (ok)', 5)} AS total_profit,
  {near(f'sum(CASE WHEN {UP} THEN 100 * y_true ELSE 0 END) FILTER (ok) / count(*) FILTER (ok)', 6)} AS profit_per_investment,
  {near(f'count(*) FILTER (ok AND {UP} AND {HIT}) / count(*) FILTER (ok AND {UP})', 7)} AS custom_accuracy,
  count(*) FILTER (ok AND {UP}) AS investments_made, count(*) FILTER (ok AND {UP} AND {HIT}) AS profitable_investments"""
EVAL_KEYS = ["samples_evaluated", "total_test_samples", "investments_made", "profitable_investments"]
EVAL_DIGITS = {"samples_kept_ratio": 7, "average_confidence": 7, "mse": 8, "mae": 8, "r2_score": 6, "total_profit": 5,
               "profit_per_investment": 6, "custom_accuracy": 7}


@query("e11_evaluate_at_threshold", sql(f"{EVAL} FROM (SELECT *, confidence >= 0.8 AS ok FROM scored)", "scored"))
def e11(spark, folder):
    return shown(ev.evaluate_at(views.scored(spark, folder), 0.8), EVAL_KEYS, EVAL_DIGITS)


def broken_confidence(spark, folder):
    c, i = F.col("confidence"), F.col("id")
    return views.scored(spark, folder).withColumn("confidence", F.when(i % 11 == 0, float("nan")).when(i % 13 == 0, float("inf")).otherwise(c))


@query("e12_threshold_policy", sql(f"""SELECT count(*) FILTER (fin AND confidence > 0.6) AS samples_kept, count(*) AS total_samples,
  {near('count(*) FILTER (fin AND confidence > 0.6) / count(*)', 7)} AS samples_kept_ratio, count(*) FILTER (NOT fin) AS non_finite_confidence_count
FROM (SELECT *, id % 11 <> 0 AND id % 13 <> 0 AS fin FROM scored)""", "scored"))
def e12(spark, folder):
    out = ev.policy_statistics(broken_confidence(spark, folder), 0.6, "gt")
    return shown(out, ["samples_kept", "total_samples", "non_finite_confidence_count"], {"samples_kept_ratio": 7})


@query("e13_error_metrics", sql(f"""SELECT date, {near('avg(y_pred - y_true)', 7)} AS mean_diff,
  {near('avg(CASE WHEN (y_true > 0 AND y_true > y_pred) OR (y_true < 0 AND y_pred < y_true) THEN 0 ELSE abs(y_true - y_pred) END)', 7)} AS conditional_mae FROM scored GROUP BY 1""", "scored"))
def e13(spark, folder):
    return shown(ev.error_metrics(views.scored(spark, folder), ["date"]), ["date"], {"mean_diff": 7, "conditional_mae": 7})


# Predictions with open positions: the actual return of some rows is not known yet.
RESULT = """SELECT s.id, s.ticker_id, coalesce(t.ticker, CAST(s.ticker_id AS VARCHAR)) AS ticker, coalesce(t.name, 'Unknown') AS company_name, s.date,
  y_pred AS predicted_return, current_price * (1 + y_pred) AS predicted_price, current_price, CASE WHEN s.id % 9 > 0 THEN y_true END AS actual_return, confidence
FROM scored s LEFT JOIN tickers t ON t.id = s.ticker_id"""
PICKED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY confidence DESC, ticker_id, id) AS rank_in_day FROM result
  WHERE predicted_return > 0 AND confidence >= 0.3) WHERE rank_in_day <= 10"""
DONE = """SELECT *, current_price * (1 + actual_return) AS actual_price,
  (current_price * (1 + actual_return) - current_price) * 100 / nullif(current_price, 0) AS profit_100_investment,
  predicted_price - current_price * (1 + actual_return) AS price_prediction_error,
  CASE WHEN actual_return IS NOT NULL THEN CAST(current_price * (1 + actual_return) > predicted_price AS INTEGER) END AS beat_prediction FROM picked"""
SEL = {"result": RESULT, "picked": PICKED, "done": DONE}


def results(spark, folder):
    s = views.scored(spark, folder)
    s = s.withColumn("y_true", F.when(F.col("id") % 9 > 0, F.col("y_true")))
    return ev.result_frame(s, views.tickers(spark, folder))


def chosen(spark, folder):
    return ev.outcomes(ev.select_daily(results(spark, folder), 0.3))


@query("e14_result_frame", sql(f"SELECT id, ticker, company_name, date, predicted_return, {near('predicted_price', 6)} AS predicted_price, current_price, actual_return FROM result", "scored", "tickers", result=RESULT))
def e14(spark, folder):
    return shown(results(spark, folder), ["id", "ticker", "company_name", "date", "predicted_return", "current_price", "actual_return"], {"predicted_price": 6})


@query("e15_daily_top10", sql("SELECT id, ticker, date, confidence, rank_in_day, dayname(date) AS day_of_week FROM picked", "scored", "tickers", result=RESULT, picked=PICKED))
def e15(spark, folder):
    return ev.select_daily(results(spark, folder), 0.3).select("id", "ticker", "date", "confidence", "rank_in_day", "day_of_week")


OUT = {"actual_price": 6, "profit_100_investment": 6, "price_prediction_error": 6, "beat_prediction": None}


@query("e16_outcomes", sql(f"""SELECT id, date, {near('actual_price', 6)} AS actual_price, {near('profit_100_investment', 6)} AS profit_100_investment,
  {near('price_prediction_error', 6)} AS price_prediction_error, beat_prediction FROM done""", "scored", "tickers", **SEL))
def e16(spark, folder):
    return shown(chosen(spark, folder), ["id", "date"], OUT)


WEEK = """SELECT coalesce(avg(profit_100_investment) FILTER (actual_price > 0), 0) AS avg_profit,
  coalesce(avg(profit_100_investment) FILTER (actual_price > 0 AND isodow(date) = 5), 0) AS friday_avg,
  coalesce(avg(profit_100_investment) FILTER (actual_price > 0 AND isodow(date) = 1), 0) AS monday_avg,
  count(*) FILTER (actual_price IS NULL) AS open_positions FROM done"""


@query("a14_weekday_profit", sql(f"SELECT {near('avg_profit', 6)} AS avg_profit, {near('friday_avg', 6)} AS friday_avg, {near('monday_avg', 6)} AS monday_avg, open_positions FROM week", "scored", "tickers", **SEL, week=WEEK))
def a14(spark, folder):
    return shown(ev.weekday_profit(chosen(spark, folder)), ["open_positions"], {"avg_profit": 6, "friday_avg": 6, "monday_avg": 6})


@query("e17_export_rule", sql("""SELECT id, date FROM done, week WHERE open_positions > 0 AND (
  (friday_avg > 0.5 AND monday_avg > 0.5) OR (friday_avg > 0.5 AND isodow(date) = 5) OR (monday_avg > 0.5 AND isodow(date) = 1))""", "scored", "tickers", **SEL, week=WEEK))
def e17(spark, folder):
    return ev.exportable(chosen(spark, folder), min_profit=0.5).select("id", "date")


@query("s27_prediction_export", sql(f"SELECT ticker, company_name, date, {near('actual_price', 4)} AS actual_price, {near('profit_100_investment', 4)} AS profit_100_investment FROM done", "scored", "tickers", **SEL))
def s27(spark, folder):
    path = fresh_path(spark, "predictions")
    out = chosen(spark, folder).select(*ev.EXPORT_COLUMNS)
    storage.export_csv(out, path)
    back = spark.read.option("header", "true").schema(out.schema).csv(path)
    return shown(back, ["ticker", "company_name", "date"], {"actual_price": 4, "profit_100_investment": 4})


RUNS = "SELECT r AS run_id, d.* FROM done d JOIN (SELECT unnest(range(4)) AS r) ON d.id % (r + 2) = 0"


@query("e18_compare_runs", sql(f"""SELECT CAST(run_id AS INTEGER) AS run_id, {near('p', 6)} AS avg_profit, n AS rows, CAST(p = max(p) OVER () AS INTEGER) AS is_best
FROM (SELECT run_id, avg(profit_100_investment) AS p, count(*) AS n FROM runs WHERE actual_price > 0 GROUP BY 1)""", "scored", "tickers", **SEL, runs=RUNS))
def e18(spark, folder):
    """Four runs, each having selected another part of the predictions."""
    d = chosen(spark, folder).withColumn("run_id", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    out = ev.compare_runs(d.where(F.col("id") % (F.col("run_id") + 2) == 0))
    return shown(out, ["run_id", "rows", "is_best"], {"avg_profit": 6})


@query("e24_best_threshold_reused", sql(f"""{EVAL}, any_value(best) AS optimal_threshold FROM (
  SELECT s.*, b.threshold AS best, confidence >= b.threshold AS ok FROM scored s, (SELECT threshold FROM kept ORDER BY round(p / n, 9) DESC, threshold LIMIT 1) b)""",
    "scored", sw=SWEEP, kept=SWEPT))
def e24(spark, folder):
    return shown(ev.evaluate_with_sweep(views.scored(spark, folder)), [*EVAL_KEYS, "optimal_threshold"], EVAL_DIGITS)
