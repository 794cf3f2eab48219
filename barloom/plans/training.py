"""Queries: training and prediction sets, cleaning, column statistics and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, prepare, trend
from ..sources import views
from .common import near, query, rounded, shown
from .indicators import lag, roll
from .views import sql

W = "PARTITION BY ticker ORDER BY date"
K = ["ticker", "date"]
SPLIT = "1999-06-01"

# Input panel: bars, two averages, a return, a ratio with gaps, and the targets.
TF = f"""SELECT ticker, date, ticker_id, open, high, low, close, CAST(volume AS DOUBLE) AS volume,
  {roll('avg', 'close', 5)} AS "SMA_5", {roll('avg', 'close', 20)} AS "SMA_20", close / {lag('close')} - 1 AS "Return_1D",
  volume / nullif(high - low, 0) AS "Volume_Range_Ratio", abs(close - open) AS "Body_Size", 7.0::DOUBLE AS "Fixed", close * 2 AS "Double_Close",
  lead(close, 10) OVER ({W}) / close - 1 AS "Future_Return_10D" FROM bars"""
DERIVED = """SELECT *, close / "SMA_5" AS "SMA_5_Ratio", close / "SMA_20" AS "SMA_20_Ratio",
  abs("Return_1D") / (volume + 1e-8) AS "Return_Volume_Efficiency", close / open AS "Close_Open_Ratio",
  CAST(date - DATE '2020-01-01' AS DOUBLE) AS date_int, CAST(year(date) AS DOUBLE) AS year, CAST(month(date) AS DOUBLE) AS month,
  CAST(dayofyear(date) AS DOUBLE) AS day_of_year, CAST(quarter(date) AS DOUBLE) AS quarter, CAST(isodow(date) - 1 AS DOUBLE) AS day_of_week,
  CAST(last_day(date) = date AS DOUBLE) AS is_month_end, CAST(last_day(date) = date AND month(date) % 3 = 0 AS DOUBLE) AS is_quarter_end
FROM tf WHERE "Future_Return_10D" IS NULL OR "Future_Return_10D" BETWEEN -0.7 - 1e-9 AND 1 + 1e-9"""
RAW = {"ticker_id": None, "open": None, "high": None, "low": None, "close": None, "volume": None, "SMA_5": 5, "SMA_20": 5, "Return_1D": 6,
       "Volume_Range_Ratio": 4, "Body_Size": None, "Fixed": None, "Double_Close": None}
NAMES = RAW | {"SMA_5_Ratio": 6, "SMA_20_Ratio": 6, "Return_Volume_Efficiency": 6, "Close_Open_Ratio": 6, "date_int": None, "year": None,
               "month": None, "day_of_year": None, "quarter": None, "day_of_week": None, "is_month_end": None, "is_quarter_end": None}
GAPPY = ["SMA_5", "SMA_20", "Return_1D", "Volume_Range_Ratio", "SMA_5_Ratio", "SMA_20_Ratio", "Return_Volume_Efficiency"]


def q(c):
    return f'"{c}"'


def medians(source, columns=GAPPY):
    return "SELECT " + ", ".join(f'quantile_cont({q(c)}, 0.5) AS "m_{c}"' for c in columns) + f" FROM {source}"


def filled(columns, source, extra=""):
    return "SELECT ticker, date" + extra + ", " + ", ".join(
        f'coalesce({q(c)}, "m_{c}") AS {q(c)}' if c in GAPPY else f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in columns) + f' FROM {source}'


TRAIN = {
    "tf": TF, "dv": DERIVED,
    "sp": f"""SELECT *, CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS split FROM dv WHERE "Future_Return_10D" IS NOT NULL""",
    "md": medians("sp WHERE split = 'train'"),
    "ts": filled(NAMES, "sp, md WHERE split = 'train' OR isodow(date) IN (1, 5)", ', split, "Future_Return_10D"'),
}


def out(columns, extra=""):
    return "SELECT ticker, date" + extra + ", " + ", ".join(
        f"{q(c)}" if d is None else f"{near(q(c), d)} AS {q(c)}" for c, d in columns.items())


def panel(spark, folder):
    b = views.bars(spark, folder).drop("adjusted_close", "vwap")
    b = features.returns(trend.sma(b, (5, 20)), (1,)).drop("Log_Return_1D")
    b = b.withColumns({
        "volume": F.col("volume").cast("double"),
        "Volume_Range_Ratio": F.try_divide(F.col("volume").cast("double"), F.col("high") - F.col("low")),
        "Body_Size": F.abs(F.col("close") - F.col("open")), "Fixed": F.lit(7.0), "Double_Close": F.col("close") * 2})
    return features.targets(b, (10,)).drop("dayofweek", "Future_High_10D", "Target_Date_10D")


def training(spark, folder, **options):
    return prepare.training_set(panel(spark, folder), 10, SPLIT, **options)


TARGET = {"Future_Return_10D": 6}


@query("p1_training_set", sql(out(NAMES | TARGET, ", split") + " FROM ts", "bars", **TRAIN))
def p1(spark, folder):
    return shown(training(spark, folder)[0], [*K, "split"], NAMES | TARGET)


ALL_MEDIANS = TRAIN | {"md": medians("sp")}


@query("p1_medians_of_all_rows", sql(out(NAMES | TARGET, ", split") + " FROM ts", "bars", **ALL_MEDIANS))
def p1_all(spark, folder):
    return shown(training(spark, folder, fit_on="all")[0], [*K, "split"], NAMES | TARGET)


PREDICT = {
    "tf": TF, "dv": DERIVED, "sp": "SELECT * FROM dv WHERE isodow(date) IN (1, 5)", "md": medians("sp"),
    "ps": filled(NAMES, "sp, md WHERE date >= DATE '2000-01-01'", ', "Future_Return_10D"'),
}


@query("p2_prediction_set", sql(out(NAMES | TARGET) + " FROM ps", "bars", **PREDICT))
def p2(spark, folder):
    return shown(prepare.prediction_set(panel(spark, folder), 10, "2000-01-01")[0], K, NAMES | TARGET)


@query("p4_last_days", sql(out({"close": None, "SMA_5": 5, "date_int": None}) + " FROM ps WHERE date_int >= (SELECT max(date_int) FROM ps) - 60", "bars", **PREDICT))
def p4(spark, folder):
    df = prepare.prediction_set(panel(spark, folder), 10, "2000-01-01")[0]
    return shown(prepare.last_days(df, 60), K, {"close": None, "SMA_5": 5, "date_int": None})


CLEAN_COLUMNS = ["close", "volume", "SMA_5", "SMA_20", "Return_1D", "Volume_Range_Ratio"]


@query("p5_clean_numeric", sql("SELECT ticker, date, " + ", ".join(
    near(f"CAST(CAST(coalesce({q(c)}, {q('m_' + c)}) AS FLOAT) AS DOUBLE)", 2) + f" AS {q(c)}" for c in CLEAN_COLUMNS) + " FROM tf, md",
    "bars", tf=TF, md=medians("tf", CLEAN_COLUMNS)))
def p5(spark, folder):
    df = prepare.clean_numeric(panel(spark, folder), CLEAN_COLUMNS)
    return df.select(*K, *[rounded(F.col(c).cast("double"), 2).alias(c) for c in CLEAN_COLUMNS])


def removal_sql(constant, ordered):
    parts = [f"SELECT 'constant' AS reason, '{c}' AS feature WHERE (SELECT min({q(c)}) = max({q(c)}) FROM ts)" for c in ordered if c not in prepare.ESSENTIAL]
    left = [c for c in ordered if c not in constant]
    for j, c in enumerate(left):
        if j and c not in prepare.ESSENTIAL:
            cond = " OR ".join(f"abs(corr({q(a)}, {q(c)})) > 0.99" for a in left[:j])
            parts.append(f"SELECT 'high_correlation', '{c}' WHERE (SELECT {cond} FROM ts)")
    return " UNION ALL ".join(parts)


# Weekly bars start on Mondays, so the weekday and, in these data, the month ends are constant or nearly so.
CONSTANT = ("Fixed", "day_of_week")


@query("p6_removed_columns", sql(removal_sql(CONSTANT, list(NAMES)), "bars", **TRAIN))
def p6(spark, folder):
    """The removal report as rows; the kept columns are everything else."""
    df, _, names = training(spark, folder)
    _, removed = prepare.remove_columns(df, names)
    pairs = [(r, c) for r, cols in removed.items() for c in cols]
    return df.sparkSession.createDataFrame(pairs, "reason string, feature string")


KEPT = ["close", "volume", "SMA_5_Ratio", "Return_1D"]


@query("p3_cleaned_training_set", sql(out({c: NAMES[c] for c in KEPT} | TARGET, ", split") + " FROM ts", "bars", **TRAIN))
def p3(spark, folder):
    df, target, kept, removed = prepare.prepared_training_set(panel(spark, folder), 10, SPLIT)
    assert "Double_Close" not in kept and "Fixed" in removed["constant"]
    return shown(df, [*K, "split"], {c: NAMES[c] for c in KEPT} | TARGET)


COMMON = TRAIN | {
    "qs": """SELECT quantile_cont("Future_Return_10D", 0.05) AS lo, quantile_cont("Future_Return_10D", 0.95) AS hi FROM ts WHERE split = 'train'""",
    "cut": "SELECT min(date_int) AS d FROM (SELECT DISTINCT date_int FROM ts WHERE split = 'test' ORDER BY 1 DESC LIMIT 11)",
}


@query("p7_common_training_data", sql(out({"close": None, "SMA_20": 5} | TARGET, ", split") + """ FROM ts, qs, cut
WHERE (split = 'train' AND "Future_Return_10D" BETWEEN lo AND hi) OR (split = 'test' AND date_int < d)""", "bars", **COMMON))
def p7(spark, folder):
    df, target, names = training(spark, folder)
    return shown(prepare.common_training_data(df, target, names), [*K, "split"], {"close": None, "SMA_20": 5} | TARGET)


BROKEN = "CASE WHEN volume % 11 = 0 THEN 'NaN'::DOUBLE WHEN volume % 13 = 0 THEN 'Infinity'::DOUBLE WHEN volume % 17 = 0 THEN NULL ELSE close END"


@query("p8_zero_fill", sql("SELECT ticker, date, CASE WHEN volume % 11 = 0 OR volume % 13 = 0 OR volume % 17 = 0 THEN 0.0::DOUBLE ELSE close END AS close FROM bars", "bars"))
def p8(spark, folder):
    v, c = F.col("volume"), F.col("close")
    b = views.bars(spark, folder).withColumn(
        "close", F.when(v % 11 == 0, float("nan")).when(v % 13 == 0, float("inf")).when(v % 17 == 0, None).otherwise(c))
    return prepare.zero_fill(b, ["close"]).select(*K, "close")


SCALED = ["close", "volume", "SMA_5", "Fixed"]


@query("p9_standard_scaling", sql("SELECT ticker, date, " + ", ".join(
    near(f"({q(c)} - (SELECT avg({q(c)}) FROM ts WHERE split = 'train')) / coalesce(nullif((SELECT stddev_pop({q(c)}) FROM ts WHERE split = 'train'), 0), 1)", 6)
    + f" AS {q(c)}" for c in SCALED) + " FROM ts", "bars", **TRAIN))
def p9(spark, folder):
    df, _, _ = training(spark, folder)
    return shown(prepare.standard_scale(df, SCALED, df.where("split = 'train'")), K, {c: 6 for c in SCALED})


CORR_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({q(c)}, \"Future_Return_10D\")) AS correlation FROM ts" for c in NAMES if c not in CONSTANT)


@query("p10_top_by_correlation", sql(f"""SELECT feature, {near('correlation', 6)} AS correlation,
  CAST(rk <= 8 - m OR (rk > 8 AND feature IN ('close', 'date_int', 'ticker_id')) AS INTEGER) AS chosen
FROM (SELECT *, row_number() OVER (ORDER BY round(correlation, 9) DESC, feature) AS rk FROM cl WHERE feature NOT IN ('is_month_end', 'is_quarter_end')),
  (SELECT count(*) AS m FROM (SELECT feature, row_number() OVER (ORDER BY round(correlation, 9) DESC, feature) AS rk FROM cl WHERE feature NOT IN ('is_month_end', 'is_quarter_end'))
   WHERE rk > 8 AND feature IN ('close', 'date_int', 'ticker_id'))""", "bars", **TRAIN, cl=CORR_LONG))
def p10(spark, folder):
    df, target, names = training(spark, folder)
    names = [c for c in names if c not in (*CONSTANT, "is_month_end", "is_quarter_end", "Double_Close")] + ["Double_Close"]
    best = prepare.top_by_correlation(df, names, target, 8)
    corr = prepare.target_correlations(df, names, target)
    return corr.select("feature", rounded("correlation", 6).alias("correlation"), F.col("feature").isin(best).cast("int").alias("chosen"))


@query("p12_sparse_columns", sql("""SELECT 'Fixed' AS feature WHERE (SELECT min("Fixed") = max("Fixed") FROM tf)
UNION ALL SELECT 'Mostly_Missing' WHERE (SELECT avg(CASE WHEN volume < 100 THEN 1 ELSE 0 END) FROM tf) > 0.95""", "bars", tf=TF))
def p12(spark, folder):
    df = panel(spark, folder).withColumn("Mostly_Missing", F.when(F.col("volume") >= 100, F.col("close")))
    names = prepare.sparse_columns(df, ["close", "SMA_5", "Fixed", "Mostly_Missing"])
    return df.sparkSession.createDataFrame([(c,) for c in names], "feature string")


@query("p12_last_tenth_as_validation", sql("""SELECT date, n AS rows, CASE WHEN from_here <= 0.1 * total THEN 'validation' ELSE 'train' END AS part FROM (
  SELECT date, n, sum(n) OVER (ORDER BY date DESC) AS from_here, sum(n) OVER () AS total FROM (SELECT date, count(*) AS n FROM bars GROUP BY 1))""", "bars"))
def p12b(spark, folder):
    df = prepare.split_off_last(views.bars(spark, folder).select("ticker", "date"))
    return df.groupBy("date", "part").agg(F.count(F.lit(1)).alias("rows"))


@query("p14_restrict_columns", sql('SELECT "SMA_5_Ratio" IS NULL AS no_ratio, 0.0::DOUBLE AS "Unknown_Feature", close, ticker_id FROM dv', "bars", tf=TF, dv=DERIVED))
def p14(spark, folder):
    df = prepare.derived_features(features.return_target(panel(spark, folder), 10)[0])
    out_ = prepare.restrict(df, ["SMA_5_Ratio", "Unknown_Feature"], ("close", "ticker_id"))
    return out_.select(F.col("SMA_5_Ratio").isNull().alias("no_ratio"), "Unknown_Feature", "close", "ticker_id")


@query("p15_categorical_columns", sql("SELECT feature FROM (VALUES ('ticker'), ('ticker_id'), ('volume_class')) t(feature) WHERE (SELECT count(DISTINCT volume % 5) FROM bars) < 50", "bars"))
def p15(spark, folder):
    df = views.bars(spark, folder).withColumn("volume_class", (F.col("volume") % 5).cast("int"))
    names = prepare.categorical_columns(df, ["ticker", "ticker_id", "close", "volume", "volume_class"])
    return df.sparkSession.createDataFrame([(c,) for c in names], "feature string")


@query("p16_constant_columns", sql("""SELECT 'Fixed' AS feature WHERE (SELECT min("Fixed") = max("Fixed") FROM tf)""", "bars", tf=TF))
def p16(spark, folder):
    df = panel(spark, folder)
    names = prepare.check_not_constant(df, ["close", "volume", "SMA_5", "Fixed"])
    return df.sparkSession.createDataFrame([(c,) for c in names], "feature string")


@query("p17_without_recent", sql("SELECT ticker, date, close FROM bars WHERE date < (SELECT max(date) FROM bars) - 15", "bars"))
def p17(spark, folder):
    return prepare.without_recent(features.calendar(views.bars(spark, folder))).select(*K, "close")


@query("p19_float32", sql("SELECT ticker, date, CAST(CAST(close AS FLOAT) AS DOUBLE) AS close, CAST(CAST(volume AS FLOAT) AS DOUBLE) AS volume FROM bars", "bars"))
def p19(spark, folder):
    df = prepare.to_float32(views.bars(spark, folder).select(*K, "close", "volume"))
    return df.select(*K, *[F.col(c).cast("double").alias(c) for c in ("close", "volume")])


STAT_COLUMNS = ["close", "volume", "SMA_20", "Return_1D", "Volume_Range_Ratio", "Fixed"]
STATS = " UNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) AS n, count(*) - count({q(c)}) AS missing, var_samp({q(c)}) AS variance,
  CAST(min({q(c)}) = max({q(c)}) AS INTEGER) AS constant, count(DISTINCT {q(c)}) AS n_distinct FROM tf""" for c in STAT_COLUMNS)


@query("a11_feature_diversity", sql(f"""SELECT feature, {near('variance', 1)} AS variance, constant,
  CASE WHEN variance = 0 THEN 'zero' WHEN variance < 1e-8 THEN 'low' ELSE 'useful' END AS variance_class FROM st""", "bars", tf=TF, st=STATS))
def a11(spark, folder):
    return shown(prepare.diversity(panel(spark, folder), STAT_COLUMNS), ["feature", "constant", "variance_class"], {"variance": 1})


@query("a11_column_statistics", sql(f"SELECT feature, n, missing, constant, {near('variance', 1)} AS variance FROM st", "bars", tf=TF, st=STATS))
def a11b(spark, folder):
    out_ = prepare.column_statistics(panel(spark, folder), STAT_COLUMNS)
    return shown(out_, ["feature", "n", "missing", "constant"], {"variance": 1})


@query("a11_distinct_counts", sql("SELECT feature, n_distinct FROM st WHERE feature IN ('close', 'volume', 'Fixed')", "bars", tf=TF, st=STATS))
def a11c(spark, folder):
    return prepare.column_statistics(panel(spark, folder), ["close", "volume", "Fixed"], by_value=True).select("feature", "n_distinct")


@query("a11_top_variance", sql(f"SELECT feature, {near('variance', 1)} AS variance FROM st WHERE variance >= 1e-8 ORDER BY variance DESC LIMIT 3", "bars", tf=TF, st=STATS))
def a11d(spark, folder):
    return shown(prepare.diversity_top(panel(spark, folder), STAT_COLUMNS, 3), ["feature"], {"variance": 1})


CORR_COLUMNS = ["open", "close", "volume", "SMA_5", "Return_1D"]


@query("a12_correlations", sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {near(f'corr(coalesce({q(a)}, 0), coalesce({q(b)}, 0))', 5)} AS correlation FROM tf"
    for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1:]), "bars", tf=TF))
def a12(spark, folder):
    df = panel(spark, folder)
    m = prepare.correlation_matrix(df, CORR_COLUMNS)
    pairs = [(a, b, float(m[i][i + 1 + j])) for i, a in enumerate(CORR_COLUMNS) for j, b in enumerate(CORR_COLUMNS[i + 1:])]
    return shown(df.sparkSession.createDataFrame(pairs, "a string, b string, correlation double"), ["a", "b"], {"correlation": 5})


@query("e22_input_report", sql(f"""SELECT feature, {near('mean', 5)} AS mean, {near('std', 5)} AS std, missing, (SELECT count(DISTINCT ticker) FROM tf) AS tickers FROM (
  SELECT 'close' AS feature, avg(close) AS mean, stddev_samp(close) AS std, 0 AS missing FROM tf
  UNION ALL SELECT 'SMA_5', avg("SMA_5"), stddev_samp("SMA_5"), 0 FROM tf UNION ALL SELECT 'Absent', NULL, NULL, 1)""", "bars", tf=TF))
def e22(spark, folder):
    df = panel(spark, folder)
    return shown(prepare.input_report(df, df.columns, ["close", "SMA_5", "Absent"]), ["feature", "missing", "tickers"], {"mean": 5, "std": 5})
