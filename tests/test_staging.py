"""Finished columns travel through later levels as one struct."""

import datetime as dt

import numpy as np

from barloom.functions import staging
from barloom.operators import features, trend, volatility

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume long"


def bars(spark, n=70):
    close = 50 + np.cumsum(np.random.default_rng(5).normal(0, 1, n))
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(c), float(c + 1), float(c - 1), float(c), 100 + i % 7) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_finished_columns_are_packed(spark):
    panel = bars(spark)
    out, found = staging.staged(panel, *trend.trend_levels(), *volatility.volatility_levels())
    assert any(c.startswith("_done_") for c in out.columns)
    assert "SMA_200" not in out.columns and "EMA_5" not in out.columns
    whole = staging.apply(panel, *trend.trend_levels(), *volatility.volatility_levels())
    assert whole.columns == [*panel.columns, *found]
    alone = staging.apply(panel, trend.sma_levels()).select("date", "SMA_50").collect()
    assert sorted(alone) == sorted(whole.select("date", "SMA_50").collect())


def test_what_is_not_asked_for_is_pruned(spark):
    text = plan(features.all_features(bars(spark)).select("ticker", "date", "SMA_5", "Return_1D"))
    assert "EMA_200" not in text and "Vol_Clustering" not in text and "AD_Line" not in text


def test_all_features_in_order(spark):
    out = features.all_features(bars(spark))
    names = [n for xs in features.CATEGORIES.values() for x in xs() for n in x.outputs]
    assert out.columns[7 : 7 + len(names)] == names and not [c for c in out.columns if c.startswith("_")]
