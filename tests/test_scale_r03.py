"""What keeps the wide panels within their limits: shared sorted frames, tasks by input size, counts per row, bars written once."""

import datetime as dt
import math

import numpy as np

from barloom.functions import windows as w
from barloom.functions.shared import spread
from barloom.operators import validate, volatility
from barloom.plans import panel as plans

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume long"


def rows(tickers=3, n=130):
    rng = np.random.default_rng(3)
    return [
        (f"T{t}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(c), float(c + 1), float(c - 1), float(c), 100)
        for t in range(tickers) for i, c in enumerate(50 + np.cumsum(rng.normal(0, 1, n)))
    ]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_quantiles_share_one_sorted_frame(spark):
    bars = spark.createDataFrame(rows(), SCHEMA)
    got = bars.withColumn("v", w.rolling_sorted("close", 50)).withColumns({f"q{int(q * 10)}": w.quantile_of("v", 50, q) for q in (0.2, 0.7, 0.8)})
    for _, g in got.toPandas().sort_values(["ticker", "date"]).groupby("ticker"):
        for q in (0.2, 0.7, 0.8):
            np.testing.assert_allclose(g[f"q{int(q * 10)}"].astype(float), g.close.rolling(50).quantile(q), rtol=1e-12)
    assert "percentile(" not in plan(volatility.volatility(bars))


def test_sorted_frame_waits_for_values(spark):
    data = [("A", dt.date(2020, 1, 1 + i), x) for i, x in enumerate([1.0, None, 3.0, 2.0, math.inf])]
    got = spark.createDataFrame(data, "ticker string, date date, x double").withColumn("v", w.rolling_sorted("x", 2)).orderBy("date").collect()
    assert [r.v for r in got] == [None, None, None, [2.0, 3.0], [2.0, math.inf]]


def test_tasks_follow_the_input(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(path)
    bars = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    few, many = spread(bars), spread(bars, task_bytes=64)
    assert few.rdd.getNumPartitions() <= max(cores, 4)
    assert many.rdd.getNumPartitions() > cores
    assert many.exceptAll(bars).isEmpty() and many.count() == bars.count()
    homes = many.rdd.glom().map(lambda part: {r.ticker for r in part}).collect()
    assert sum(len(h) for h in homes) == 3


def test_quality_counts_per_row(spark):
    data = [("A", 1.0, None), ("A", math.inf, 2.0), ("B", None, None), ("C", 1.0, 2.0)]
    df = spark.createDataFrame(data, "ticker string, x double, y double")
    out = validate.category_quality(df, ["x", "y"])
    got = {r.ticker: (r.quality_score, r.has_infinite) for r in out.collect()}
    assert got == {"A": (75.0, 1), "B": (0.0, 0), "C": (100.0, 0)}
    assert plan(out).count("sum(") == 1


def test_category_tables_read_bars_once(spark):
    tables = plans.category_tables(spark, "/root/testdata/sf0.001")
    assert all("category-bars" in f for t in tables.values() for f in t.inputFiles())
