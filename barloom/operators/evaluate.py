"""Confidence, threshold sweep, profit, metrics and selection of predictions.

Input frames hold y_true (actual return), y_pred (predicted return), current_price,
confidence, and for selection ticker_id, date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import to_price


def with_company(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Ticker and name by ticker_id, with the id and 'Unknown' as fallbacks."""
    side = tickers.select(F.col("id").alias("ticker_id"), "ticker", "name")
    return df.join(side, "ticker_id", "left").withColumns({
        "ticker": F.coalesce("ticker", F.col("ticker_id").cast("string")),
        "company_name": F.coalesce("name", F.lit("Unknown")),
    }).drop("name")


# Confidence ---------------------------------------------------------------------------


def min_max(df: DataFrame, score: Column, name: str = "confidence") -> DataFrame:
    """score scaled to [0, 1]; 0.5 when flat. The bounds are a one-row scalar subquery."""
    raw = df.withColumn("_s", score)
    ends = raw.agg(F.struct(F.min("_s").alias("lo"), F.max("_s").alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    return raw.withColumn(
        name, F.when(hi > lo, F.try_divide(F.col("_s") - lo, hi - lo)).otherwise(0.5)
    ).drop("_s")


def confidence_margin(df, pred="y_pred"):
    return min_max(df, F.abs(pred))


def confidence_simple(df, pred="y_pred", price="current_price"):
    change = F.try_divide(F.abs(F.col(pred) - F.col(price)), F.col(price))
    return min_max(df, F.least(F.greatest(change, F.lit(0.0)), F.lit(1.0)))


def confidence_leaf_depth(df, leaves="leaves"):
    """Mean leaf index over the trees, squared."""
    total = F.aggregate(leaves, F.lit(0.0), lambda a, x: a + x)
    return min_max(df, F.pow(total / F.size(leaves), F.lit(2.0)))


def confidence_variance(df, per_tree="tree_predictions"):
    """1 / (1 + population variance of the single-tree predictions)."""
    n = F.size(per_tree)
    mean = F.aggregate(per_tree, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(F.transform(per_tree, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n
    return min_max(df, F.lit(1.0) / (1 + spread))


def confidence_tanh(df, pred="y_pred"):
    return df.withColumn("confidence", F.tanh(F.abs(pred)))


def confidence_over_max(df, pred="y_pred"):
    top = df.agg(F.max(pred)).scalar()
    return df.withColumn("confidence", F.when(F.abs(top) <= 1e-8, 0.0).otherwise(F.abs(F.try_divide(F.col(pred), top))))


def confidence_from_mean(df, pred="y_pred"):
    return df.withColumn("confidence", F.abs(F.col(pred) - df.agg(F.avg(pred)).scalar()))


def confidence_absolute(df, pred="y_pred"):
    return df.withColumn("confidence", F.abs(pred))


# Metrics ------------------------------------------------------------------------------


def hit() -> Column:
    """Conservative success: the actual return is positive and not above the predicted one."""
    return (F.col("y_true") > 0) & (F.col("y_true") <= F.col("y_pred"))


def profit(stake: float = 100.0) -> Column:
    return F.when(F.col("y_pred") > 0, F.col("y_true") * stake).otherwise(0.0)


def add_profit(df: DataFrame, stake: float = 100.0) -> DataFrame:
    return df.withColumn("profit", profit(stake))


def _share(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def conservative_accuracy() -> Column:
    up = F.col("y_pred") > 0
    return _share(F.count_if(up & hit()), F.count_if(up))


def investment_metrics(df: DataFrame, by: list[str] = ()) -> DataFrame:
    up, n = F.col("y_pred") > 0, F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.count_if(up).alias("investments_made"), _share(F.count_if(up), n).alias("investment_rate"),
        _share(F.count_if(up & hit()), F.count_if(up)).alias("investment_success_rate"),
        F.count_if(up & hit()).alias("profitable_investments"), n.alias("total_samples"),
    )


def error_metrics(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """mean(pred - true), and mean absolute error with safe misses counted as 0."""
    t, p = F.col("y_true"), F.col("y_pred")
    forgiven = ((t > 0) & (t > p)) | ((t < 0) & (p < t))
    return df.groupBy(*by).agg(
        F.avg(p - t).alias("mean_diff"), F.avg(F.when(forgiven, 0.0).otherwise(F.abs(t - p))).alias("conditional_mae")
    )


# Threshold policy and sweep -----------------------------------------------------------


def passes(threshold, method: str = "ge", column: str = "confidence") -> Column:
    """Non-finite confidence never passes."""
    if method not in ("ge", "gt"):
        raise ValueError(f"unknown threshold method {method!r}")
    c = F.col(column)
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    t = F.lit(threshold)
    return F.coalesce(finite & (c >= t if method == "ge" else c > t), F.lit(False))


def policy_statistics(df: DataFrame, threshold: float, method: str = "ge") -> DataFrame:
    c = F.col("confidence")
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    n, kept = F.count(F.lit(1)), F.count_if(passes(threshold, method))
    return df.agg(
        kept.alias("samples_kept"), n.alias("total_samples"), _share(kept, n).alias("samples_kept_ratio"),
        F.count_if(~finite).alias("non_finite_confidence_count"),
    )


def predict_with_threshold(df: DataFrame, threshold: float, method: str = "ge") -> DataFrame:
    return df.where(passes(threshold, method))


def thresholds_between(low=0.01, high=0.99, n=90) -> list[float]:
    """n evenly spaced values, the last one exact."""
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def sweep(df: DataFrame, thresholds: list[float] | None = None, stake=100.0, min_share=0.002, max_share=0.3) -> DataFrame:
    """One row per threshold that keeps an allowed number of rows.

    A row that passes a threshold passes every lower one. Rows are therefore grouped once
    by the highest threshold they pass, and suffix sums over at most len(thresholds)
    groups give every threshold's totals: one pass instead of rows times thresholds. The grid may
    be any list of thresholds; confidence that is null or not finite passes none.
    """
    ts = sorted(set(thresholds or thresholds_between()))
    grid = F.array(*map(F.lit, ts))
    n = len(ts)
    c, up = F.col("confidence"), F.col("y_pred") > 0
    # A binary search, one step a column: the number of thresholds not above the confidence.
    found = df.withColumn("_k", F.lit(0))
    step = 1 << (n.bit_length() - 1)
    while step:
        reach = F.col("_k") + step
        held = (reach <= n) & (F.element_at(grid, F.least(reach, F.lit(n))) <= c)
        found = found.withColumn("_k", F.when(held, reach).otherwise(F.col("_k")))
        step //= 2
    found = found.withColumn("_k", F.when(passes(ts[0]), F.col("_k")).otherwise(0))
    counted = found.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n"), F.sum(profit(stake)).alias("p"), F.count_if(up).alias("inv"),
        F.count_if(up & hit()).alias("ok"), F.sum("confidence").alias("conf"),
    )
    every = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "_k int, threshold double")
    levels = every.join(counted, "_k", "full").fillna(0, ["n", "inv", "ok"])
    # At most n + 1 rows reach this window.
    above = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = levels.select(
        "threshold", *[F.sum(x).over(above).alias(x) for x in ("n", "p", "inv", "ok", "conf")], F.sum("n").over(whole).alias("total")
    ).where(F.col("threshold").isNotNull())
    enough = F.greatest(F.lit(1), F.floor(F.col("total") * min_share))
    kept = sums.where((F.col("n") >= enough) & (F.col("n") <= F.floor(F.col("total") * max_share)))
    return kept.select(
        "threshold", F.col("n").alias("test_samples_kept"), (F.col("n") / F.col("total")).alias("test_samples_ratio"),
        F.col("p").alias("test_profit"), _share(F.col("ok"), F.col("inv")).alias("test_custom_accuracy"),
        (F.col("p") / F.col("n")).alias("test_profit_per_investment"),
        _share(F.col("ok"), F.col("inv")).alias("investment_success_rate"),
        F.col("ok").alias("profitable_investments"), (F.col("conf") / F.col("n")).alias("average_confidence"),
    )


def sweep_problems(df: DataFrame) -> str | None:
    """Why a sweep would not make sense, or None: too few distinct predictions, bad confidence."""
    c = F.col("confidence")
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c.isNull() | F.isnan(c)).alias("nan"),
        F.count_if(F.abs(c) == float("inf")).alias("inf"),
    ).first()
    distinct = df.select("y_pred").distinct().count()
    if distinct < row["n"] / 100:
        return f"insufficient prediction diversity: {distinct} distinct values"
    if row["nan"]:
        return "confidence contains NaN values"
    return "confidence contains infinite values" if row["inf"] else None


def require_finite_confidence(df: DataFrame) -> DataFrame:
    """df; raises where confidence is missing, NaN or infinite, as thresholds would then mean nothing."""
    c = F.col("confidence")
    row = df.agg(F.count_if(c.isNull() | F.isnan(c)).alias("nan"), F.count_if(F.abs(c) == float("inf")).alias("inf")).first()
    if row["nan"] or row["inf"]:
        raise ValueError(f"confidence has {row['nan']} missing or NaN and {row['inf']} infinite values")
    return df


def best_threshold(swept: DataFrame) -> DataFrame:
    """Best by profit per investment; the lowest threshold on ties."""
    return swept.orderBy(F.desc("test_profit_per_investment"), "threshold").limit(1)


def evaluate_at(df: DataFrame, threshold, stake=100.0, method="ge") -> DataFrame:
    """Error, profit and investment metrics of the rows that pass, in one aggregate."""
    ok = passes(threshold, method)
    t, p = F.when(ok, F.col("y_true")), F.when(ok, F.col("y_pred"))
    kept, n = F.count_if(ok), F.count(F.lit(1))
    up = ok & (F.col("y_pred") > 0)
    sse = F.sum((t - p) * (t - p))
    return df.agg(
        kept.alias("samples_evaluated"), n.alias("total_test_samples"), _share(kept, n).alias("samples_kept_ratio"),
        F.avg(F.when(ok, F.col("confidence"))).alias("average_confidence"),
        F.try_divide(sse, kept.cast("double")).alias("mse"), F.avg(F.abs(t - p)).alias("mae"),
        (1 - F.try_divide(sse, F.var_pop(t) * kept)).alias("r2_score"),
        F.coalesce(F.sum(F.when(ok, profit(stake))), F.lit(0.0)).alias("total_profit"),
        _share(F.sum(F.when(ok, profit(stake))), kept).alias("profit_per_investment"),
        _share(F.count_if(up & hit()), F.count_if(up)).alias("custom_accuracy"),
        F.count_if(up).alias("investments_made"), F.count_if(up & hit()).alias("profitable_investments"),
    )


def evaluate_with_sweep(df: DataFrame, stake=100.0) -> DataFrame:
    """Sweep, then the evaluation at the best threshold, which stays a scalar subquery."""
    best = best_threshold(sweep(require_finite_confidence(df), stake=stake))
    return evaluate_at(df, best.select("threshold").scalar(), stake).withColumn(
        "optimal_threshold", best.select("threshold").scalar()
    )


# Selection ----------------------------------------------------------------------------


def result_frame(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Ticker, name, date, predicted return and price, actual return."""
    out = with_company(df, tickers)
    return out.withColumns({
        "predicted_return": F.col("y_pred"), "actual_return": F.col("y_true"),
        "predicted_price": to_price(F.col("y_pred"), F.col("current_price")),
    }).drop("y_pred", "y_true")


def top_per_day(df: DataFrame, by: str, k: int = 10, ties: list[str] = ("ticker_id",)) -> DataFrame:
    """The k best rows per date. The rank limit is applied before the shuffle as well, so a
    date with very many rows sends at most k rows per task."""
    w = Window.partitionBy("date").orderBy(F.desc(by), *ties)
    return df.withColumn("rank_in_day", F.row_number().over(w)).where(F.col("rank_in_day") <= k)


def select_daily(df: DataFrame, threshold: float | None, k=10, only_friday=False, ties=("ticker_id", "id")) -> DataFrame:
    """Passing rows with a positive prediction, the k most confident per date. Without a
    threshold every row takes part."""
    out = df if threshold is None else df.where(passes(threshold))
    out = top_per_day(out.where(F.col("predicted_return") > 0), "confidence", k, list(ties))
    out = out.withColumn("day_of_week", F.date_format("date", "EEEE"))
    return out.where(F.col("day_of_week") == "Friday") if only_friday else out


def outcomes(df: DataFrame) -> DataFrame:
    """Actual price, profit of 100, price error and beat flag where the return is known."""
    out = df.withColumn("actual_price", to_price(F.col("actual_return"), F.col("current_price")))
    known = F.col("actual_return").isNotNull()
    return out.withColumns({
        "profit_100_investment": F.try_divide((F.col("actual_price") - F.col("current_price")) * 100, F.col("current_price")),
        "price_prediction_error": F.col("predicted_price") - F.col("actual_price"),
        "beat_prediction": F.when(known, (F.col("actual_price") > F.col("predicted_price")).cast("int")),
    })


def weekday_profit(df: DataFrame) -> DataFrame:
    """One row: mean profit overall, on Fridays, on Mondays (0 without rows), open positions."""
    done, day = F.col("actual_price") > 0, F.weekday("date")

    def mean(cond):
        return F.coalesce(F.avg(F.when(cond, F.col("profit_100_investment"))), F.lit(0.0))

    return df.agg(
        mean(done).alias("avg_profit"), mean(done & (day == 4)).alias("friday_avg"), mean(done & (day == 0)).alias("monday_avg"),
        F.count_if(F.col("actual_price").isNull()).alias("open_positions"),
    )


def exportable(df: DataFrame, min_profit: float = 10.0, min_rows: int = 5, only_friday: bool = False) -> DataFrame:
    """Rows of the days whose mean profit is high enough; nothing without an open position
    or with at most min_rows rows."""
    s = weekday_profit(df)
    stats = s.agg(F.struct(F.first("friday_avg").alias("f"), F.first("monday_avg").alias("m"), F.first("open_positions").alias("o"))).scalar()
    friday = stats.getField("f") > min_profit
    monday = (stats.getField("m") > min_profit) & F.lit(not only_friday)
    day = F.weekday("date")
    chosen = (stats.getField("o") > 0) & ((friday & monday) | (friday & (day == 4)) | (monday & (day == 0)))
    kept = df.where(chosen)
    return kept.where(kept.agg(F.count(F.lit(1))).scalar() > min_rows)


EXPORT_COLUMNS = (
    "ticker", "company_name", "date", "predicted_return", "predicted_price", "current_price", "actual_return",
    "confidence", "day_of_week", "actual_price", "profit_100_investment", "price_prediction_error", "beat_prediction",
)


def compare_runs(results: DataFrame) -> DataFrame:
    """Mean profit per run over closed positions, best first by rank."""
    per_run = results.where(F.col("actual_price") > 0).groupBy("run_id").agg(
        F.avg("profit_100_investment").alias("avg_profit"), F.count(F.lit(1)).alias("rows")
    )
    best = per_run.agg(F.max_by("run_id", F.struct("avg_profit", "run_id"))).scalar()
    return per_run.withColumn("is_best", (F.col("run_id") == best).cast("int"))
