"""Window helpers, smoothing, exact quantiles and ranks against pandas and numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import smoothing as sm
from barloom.functions import windows as w
from barloom.functions.ranks import exact_quantiles, value_ranks
from barloom.operators import momentum, trend, volatility, volume


def panel(n=120, tickers=("AAA", "BBB"), seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        for i in range(n):
            o = close[i] + rng.normal(0, 0.3)
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(o), float(max(o, close[i]) + 0.2),
                         float(min(o, close[i]) - 0.2), float(close[i]), int(rng.integers(100, 1000))))
    return rows


SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume long"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(panel(), SCHEMA).cache()


def by_ticker(df, columns):
    pdf = df.select("ticker", "date", *columns).toPandas().sort_values(["ticker", "date"])
    return {t: g.reset_index(drop=True) for t, g in pdf.groupby("ticker")}


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=tol, atol=tol, equal_nan=True)


def test_rolling_is_null_until_full(bars):
    got = by_ticker(bars.withColumn("m", w.rolling_mean("close", 5)).withColumn("s", w.rolling_std("close", 5)), ["close", "m", "s"])
    for g in got.values():
        same(g.m, g.close.rolling(5).mean())
        same(g.s, g.close.rolling(5).std())


def test_flag_of_unknown_is_zero(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "x double").select(w.flag(F.col("x") > 0).alias("f"))
    assert sorted(r.f for r in df.collect()) == [0, 1]


@pytest.mark.parametrize("run", [7, 16, 256])
def test_ema_over_run_borders(bars, run):
    """The carry between runs gives the plain recursion, whatever the run length."""
    items = [sm.ema("e", "close", 2 / 11, 10), sm.adjusted_ema("a", "close", 2 / 11)]
    for g in by_ticker(sm.smooth(bars, items, ["close"], run), ["close", "e", "a"]).values():
        same(g.e, g.close.ewm(span=10, min_periods=10, adjust=False).mean())
        same(g.a, g.close.ewm(span=10, adjust=True).mean())


def test_ema_after_leading_nulls(bars):
    df = bars.withColumn("x", F.when(F.dayofmonth("date") + F.month("date") * 31 > 40, F.col("close")))
    for g in by_ticker(sm.smooth(df, [sm.ema("e", "x", 0.2, 9)], ["x"], 10), ["x", "e"]).values():
        same(g.e, g.x.ewm(alpha=0.2, min_periods=9, adjust=False).mean())


def test_long_history_stays_finite(spark):
    rows = panel(3000, ("LONG",))
    df = sm.smooth(spark.createDataFrame(rows, SCHEMA), [sm.ema("e", "close", 2 / 3, 1), sm.ema("s", "close", 2 / 201, 1)], ["close"])
    g = by_ticker(df, ["close", "e", "s"])["LONG"]
    same(g.e, g.close.ewm(alpha=2 / 3, adjust=False).mean(), 1e-8)
    same(g.s, g.close.ewm(alpha=2 / 201, adjust=False).mean(), 1e-8)


def test_atr_seed_and_recursion(bars):
    for g in by_ticker(volatility.atr(bars), ["high", "low", "close", "ATR"]).values():
        tr = pd.concat([g.high - g.low, (g.high - g.close.shift()).abs(), (g.low - g.close.shift()).abs()], axis=1).max(axis=1)
        want = np.zeros(len(g))
        want[13] = tr[:14].mean()
        for i in range(14, len(g)):
            want[i] = (want[i - 1] * 13 + tr[i]) / 14
        same(g.ATR, want)


def test_rsi_against_wilder(bars):
    for g in by_ticker(momentum.rsi(bars, (14,)), ["close", "RSI_14"]).values():
        d = g.close.diff()
        up, down = d.where(d > 0, 0.0), -d.where(d < 0, 0.0)
        a = up.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
        b = down.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
        same(g.RSI_14, 100 - 100 / (1 + a / b))


def test_macd_signal_starts_at_first_macd(bars):
    for g in by_ticker(trend.macd(bars), ["close", "MACD", "MACD_Signal"]).values():
        f, s = (g.close.ewm(span=n, min_periods=n, adjust=False).mean() for n in (12, 26))
        same(g.MACD, f - s)
        same(g.MACD_Signal, (f - s).ewm(span=9, min_periods=9, adjust=False).mean())


def test_ratios_do_not_depend_on_price_scale(bars):
    scaled = bars.withColumns({c: F.col(c) * 7 for c in ("open", "high", "low", "close")})
    cols = ["RSI_14", "Stoch_K", "ROC_10", "Williams_R_14"]
    a, b = (by_ticker(momentum.momentum(d), cols) for d in (bars, scaled))
    for t in a:
        for c in cols:
            same(a[t][c], b[t][c], 1e-7)


def test_volume_columns_without_losses(spark):
    rows = [("UP", dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 100) for i in range(60)]
    out = volume.volume(spark.createDataFrame(rows, SCHEMA)).orderBy("date").collect()
    assert out[-1].MFI == 100.0 and out[-1].OBV == 6000.0 and out[-1].Volume_Percentile_50 == 0.5


def test_column_counts(bars):
    width = lambda f: len(f(bars).columns) - len(bars.columns)
    assert [width(f) for f in (trend.trend, momentum.momentum, volatility.volatility, volume.volume)] == [27, 34, 33, 64]


def test_indicators_share_one_exchange(bars):
    plan = trend.trend(bars.sparkSession.range(1).select(F.lit("A").alias("ticker"), F.current_date().alias("date"), *[
        F.rand().alias(c) for c in ("open", "high", "low", "close")], F.lit(1).alias("volume")))
    text = plan._jdf.queryExecution().sparkPlan().toString() and plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("run", [4, 10, 256])
def test_smoothing_over_gaps(spark, run):
    """Against pandas, and for the seeded mean against its recurrence by hand, with single and long gaps and late starts."""
    rng = np.random.default_rng(11)
    x = rng.normal(100, 5, 60)
    for gap in (3, 10, 11, 12, 25, 40, 41):
        x[gap] = np.nan
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    rows += [("B", r[1], None if i < 4 else r[2]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double")
    items = [sm.ema("e5", "x", 2 / 6, 3), sm.ema("e1", "x", 1.0, 1), sm.adjusted_ema("a", "x", 2 / 6), sm.seeded_mean("w", "x", 5), sm.seeded_mean("w1", "x", 1)]
    out = sm.smooth(df, items, ["x"], run).toPandas().sort_values(["ticker", "date"])
    for ticker, g in out.groupby("ticker"):
        v = g["x"].astype(float).reset_index(drop=True)
        same(g["e5"], v.ewm(span=5, adjust=False, min_periods=3).mean())
        same(g["e1"], v.ffill())
        same(g["a"], v.ewm(span=5, adjust=True).mean())
        want, value, seen = [], 0.0, []
        for one in v:
            if not np.isnan(one):
                seen.append(one)
                value = np.mean(seen) if len(seen) == 5 else (value * 4 + one) / 5 if len(seen) > 5 else 0.0
            want.append(value)
        same(g["w"], want)
        same(g["w1"], v.ffill().fillna(0.0))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=4000), np.full(2500, 1.25), rng.exponential(1e6, 500)])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": -x}))
    got = exact_quantiles(df, ["x", "y"], [0.0, 0.05, 0.5, 0.95, 1.0])
    same(got["x"], np.quantile(x, [0.0, 0.05, 0.5, 0.95, 1.0]))
    same(got["y"], np.quantile(-x, [0.0, 0.05, 0.5, 0.95, 1.0]))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 101])
def test_exact_quantiles_of_few_values(spark, n):
    x = np.random.default_rng(n).integers(0, 9, n).astype(float)
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"], [0.05, 0.31, 0.5, 0.99])
    same(got["x"], np.quantile(x, [0.05, 0.31, 0.5, 0.99]))


def test_exact_quantiles_with_ties_at_both_ends(spark):
    """Two million rows, nearly all of them zeros and tens: the median lies between, or is one of them."""
    half = 1_000_000
    v = F.when(F.col("id") < half, 0.0).when(F.col("id") < half + 3, F.col("id") - half + 1.0).otherwise(10.0)
    df = spark.range(2 * half + 3).select(v.alias("x"), F.when(F.col("id") < half + 9, 0.0).otherwise(1.0).alias("y"))
    got = exact_quantiles(df, ["x", "y"], [0.5, 0.25])
    assert got == {"x": [2.0, 0.0], "y": [0.0, 0.0]}


def test_exact_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("slices", [2, 64])
def test_value_ranks_of_a_hot_group(spark, slices):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": ["hot"] * 3000 + ["a", "a", "b"], "v": np.concatenate([rng.integers(0, 500, 3000), [1, 1, 2]]).astype(float)})
    got = value_ranks(spark.createDataFrame(pdf), ["g"], "v", slices).toPandas().set_index(["g", "v"])
    for (g, v), part in pdf.groupby(["g", "v"]):
        group = pdf[pdf.g == g].v
        row = got.loc[(g, v)]
        assert (row.n_equal, row.n_below, row.n_total) == (len(part), (group < v).sum(), len(group))


def test_value_ranks_when_the_sketch_varies(spark, monkeypatch):
    """A sketch may come out otherwise each time it is worked out; ranks and the shifts of the ranges must see the same one."""
    vary = F.udf(lambda cuts: [c + random.uniform(-40, 40) for c in cuts], "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a, real=F.percentile_approx: vary(real(*a)))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.createDataFrame([("a", float(i % 500)) for i in range(1000)], "g string, v double")
        got = {r.v: (r.n_equal, r.n_below, r.n_total) for r in value_ranks(df, ["g"], "v", 8).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {float(v): (2, 2 * v, 1000) for v in range(500)}
