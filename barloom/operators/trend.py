"""Trend indicators over a (ticker, date) panel of bars.

SMA_n: mean of the last n closes.
EMA_n: alpha = 2/(n+1), seeded with the first close, null for the first n-1 rows.
MACD: EMA(fast) - EMA(slow); signal: EMA of the non-null MACD values.
Ichimoku: midpoints of the high-low channel; both spans are moved forward.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.smoothing import ema
from ..functions.staging import Indicator, Level, apply
from ..functions.windows import (
    ahead, both, flag, prev, rolling_max, rolling_mean, rolling_min,
)

AVERAGE_PERIODS = (5, 10, 20, 50, 100, 200)
LOOK_AHEAD = ("Ichimoku_Chikou", "Ichimoku_Chikou_Ratio")


def sma_levels(periods=AVERAGE_PERIODS) -> Indicator:
    return Indicator([Level({f"SMA_{n}": rolling_mean("close", n) for n in periods})])


def sma(panel: DataFrame, periods=AVERAGE_PERIODS) -> DataFrame:
    """Null for tickers with fewer than n rows, as there is no full window."""
    return apply(panel, sma_levels(periods))


def ema_levels(periods=AVERAGE_PERIODS) -> Indicator:
    return Indicator([Level(smoothed=[ema(f"EMA_{n}", "close", 2 / (n + 1), n) for n in periods], inputs=["close"])])


def exponential(panel: DataFrame, periods=AVERAGE_PERIODS) -> DataFrame:
    return apply(panel, ema_levels(periods))


def macd_levels(fast=12, slow=26, signal=9) -> Indicator:
    line, sig = F.col("MACD"), F.col("MACD_Signal")
    above = flag(line > sig)
    return Indicator([
        Level(smoothed=[ema("_fast", "close", 2 / (fast + 1), fast), ema("_slow", "close", 2 / (slow + 1), slow)], inputs=["close"]),
        Level({"MACD": F.col("_fast") - F.col("_slow")}, [ema("MACD_Signal", "MACD", 2 / (signal + 1), signal)], ["MACD"]),
        Level({"MACD_Histogram": line - sig, "MACD_Above_Signal": above, "MACD_Crossover": above - prev(above)}),
    ])


def macd(panel: DataFrame, fast=12, slow=26, signal=9) -> DataFrame:
    return apply(panel, macd_levels(fast, slow, signal))


def ichimoku_levels(tenkan=9, kijun=26, senkou_b=52, displacement=26) -> Indicator:
    def middle(n):
        return (rolling_max("high", n) + rolling_min("low", n)) / 2

    t, k, close = F.col("Ichimoku_Tenkan"), F.col("Ichimoku_Kijun"), F.col("close")
    a, b = F.col("Ichimoku_Senkou_A"), F.col("Ichimoku_Senkou_B")
    return Indicator([
        Level({"Ichimoku_Tenkan": middle(tenkan), "Ichimoku_Kijun": middle(kijun), "_wide": middle(senkou_b)}),
        Level({
            "Ichimoku_Senkou_A": prev((t + k) / 2, displacement), "Ichimoku_Senkou_B": prev("_wide", displacement),
            "Ichimoku_Chikou": ahead("close", displacement), "Ichimoku_Tenkan_Above_Kijun": flag(t > k),
        }),
        Level({
            "Ichimoku_Price_Above_Cloud": flag(close > both(a, b, F.greatest)),
            "Ichimoku_Price_Below_Cloud": flag(close < both(a, b, F.least)),
            "Ichimoku_Cloud_Green": flag(a > b), "Ichimoku_Cloud_Thickness": F.abs(a - b),
        }),
    ])


def ichimoku(panel: DataFrame, tenkan=9, kijun=26, senkou_b=52, displacement=26) -> DataFrame:
    """Ichimoku_Chikou looks ahead by ``displacement`` rows; training sets leave it out."""
    return apply(panel, ichimoku_levels(tenkan, kijun, senkou_b, displacement))


def trend_levels() -> list[Indicator]:
    return [sma_levels(), ema_levels(), macd_levels(), ichimoku_levels()]


def trend(panel: DataFrame) -> DataFrame:
    return apply(panel, *trend_levels())
