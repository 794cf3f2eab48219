"""Volatility indicators.

Bollinger: mean +- 2 population deviations of 20 closes. ATR: Wilder average of the
true range seeded with the mean of the first n, 0 before the seed. Parkinson:
sqrt(mean(ln(H/L)^2) / (4 ln 2)). Quantiles interpolate linearly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.smoothing import seeded_mean
from ..functions.staging import Indicator, Level, apply
from ..functions.windows import (
    flag, history, prev, quantile_of, ratio, relative_change, rolling, rolling_mean, rolling_sorted, rolling_std,
)


def bollinger_levels(period=20, deviations=2) -> Indicator:
    close, mid, low, high = F.col("close"), F.col("BB_Middle"), F.col("BB_Lower"), F.col("BB_Upper")
    sd, width = F.col("_bb_sd"), high - low
    return Indicator([
        Level({"BB_Middle": rolling_mean("close", period), "_bb_sd": rolling(F.stddev_pop, "close", period)}),
        Level({"BB_Lower": mid - sd * deviations, "BB_Upper": mid + sd * deviations}),
        Level({
            "BB_Bandwidth": ratio(width, mid) * 100, "BB_Percent": ratio(close - low, width), "BB_Width": width,
            "BB_Above_Upper": flag(close > high), "BB_Below_Lower": flag(close < low),
            "BB_Squeeze": flag(width < rolling_mean(width, 20)), "BB_Position": ratio(close - low, width),
        }),
    ])


def bollinger(panel: DataFrame, period=20, deviations=2) -> DataFrame:
    return apply(panel, bollinger_levels(period, deviations))


def true_range():
    """Widest of the day's range and its distance to the previous close."""
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev("close")), F.abs(F.col("low") - prev("close"))
    )


def atr_levels(period=14) -> Indicator:
    usual = F.col("_atr_usual")
    return Indicator([
        Level({"_tr": true_range()}, [seeded_mean("ATR", "_tr", period)], ["_tr"]),
        Level({"_atr_usual": rolling_mean("ATR", period * 2), "ATR_Percent": ratio("ATR", "close") * 100}),
        Level({
            "ATR_High_Volatility": flag(F.col("ATR") > usual * 1.5), "ATR_Low_Volatility": flag(F.col("ATR") < usual * 0.5),
            "ATR_Upper_Band": F.col("close") + F.col("ATR") * 2, "ATR_Lower_Band": F.col("close") - F.col("ATR") * 2,
        }),
    ])


def atr(panel: DataFrame, period=14) -> DataFrame:
    return apply(panel, atr_levels(period))


def return_volatility_levels(periods=(10, 20, 30)) -> Indicator:
    square = F.pow(F.ln(ratio("high", "low")), F.lit(2.0))
    spread = ratio(F.col("high") - F.col("low"), F.col("close"))
    first = {"_ret": relative_change("close")}
    for n in periods:
        first |= {f"HL_Volatility_{n}": rolling_mean(spread, n), f"Parkinson_Vol_{n}": F.sqrt(rolling_mean(square, n) / (4 * math.log(2)))}
    return Indicator([
        Level(first), Level({f"Volatility_Std_{n}": rolling_std("_ret", n) for n in periods}),
        Level({f"Volatility_Annualized_{n}": F.col(f"Volatility_Std_{n}") * math.sqrt(252) for n in periods}),
    ])


def return_volatility(panel: DataFrame, periods=(10, 20, 30)) -> DataFrame:
    return apply(panel, return_volatility_levels(periods))


def regime_levels(short=10, long=30, window=50) -> Indicator:
    """Follows ``return_volatility_levels``: its columns exist from the third level on."""
    s = F.col(f"Volatility_Std_{short}")
    return Indicator([
        Level(), Level(), Level({"_regime": rolling_sorted(s, window)}),
        Level({
            "Vol_Regime_High": flag(s > quantile_of("_regime", window, 0.8)), "Vol_Regime_Low": flag(s < quantile_of("_regime", window, 0.2)),
            "Vol_Trend_Rising": flag(s > F.col(f"Volatility_Std_{long}")),
        }),
    ])


def volatility_regime(panel: DataFrame, short=10, long=30, window=50) -> DataFrame:
    """Needs the columns of ``return_volatility``."""
    return apply(panel, regime_levels(short, long, window))


def clustering_levels(min_rows=30) -> Indicator:
    c = F.col("Vol_Clustering")
    return Indicator([
        Level(), Level(),
        Level({"Vol_Clustering": F.when(history() >= min_rows, rolling_std("Volatility_Std_20", 10))}),
        Level({"_clusters": rolling_sorted(c, 50)}),
        Level({"Vol_Clustering_High": flag(c > quantile_of("_clusters", 50, 0.7))}),
    ])


def volatility_clustering(panel: DataFrame, min_rows=30) -> DataFrame:
    """Needs Volatility_Std_20; null and 0 for tickers below min_rows."""
    return apply(panel, clustering_levels(min_rows))


def volatility_levels() -> list[Indicator]:
    return [bollinger_levels(), atr_levels(), return_volatility_levels(), regime_levels(), clustering_levels()]


def volatility(panel: DataFrame) -> DataFrame:
    return apply(panel, *volatility_levels())
