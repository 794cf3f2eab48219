"""Momentum indicators.

RSI_n: gains and losses (first row counts as 0) smoothed with alpha = 1/n; 100 when
there is no average loss; null for the first n-1 rows; a ticker needs 2n rows.
Stochastic %K: place of the close in the n-row channel; %D: mean of three %K.
ROC_n: percent change over n rows. Williams %R: place below the n-row high.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.smoothing import ema
from ..functions.staging import Indicator, Level, apply
from ..functions.windows import (
    flag, history, prev, ratio, rolling_max, rolling_mean, rolling_min,
)


def rsi_levels(periods=(14, 21)) -> Indicator:
    move = F.col("close") - prev("close")

    def value(n):
        gain, loss = F.col(f"_g{n}"), F.col(f"_l{n}")
        x = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))
        return F.when(F.col("_rows") >= 2 * n, x)

    return Indicator([
        Level(
            {"_gain": F.when(move > 0, move).otherwise(0.0), "_loss": F.when(move < 0, -move).otherwise(0.0), "_rows": history()},
            [ema(f"_{s}{n}", c, 1 / n, n) for n in periods for s, c in (("g", "_gain"), ("l", "_loss"))], ["_gain", "_loss"],
        ),
        Level({f"RSI_{n}": value(n) for n in periods}),
        Level({
            name: cond for n in periods for name, cond in {
                f"RSI_{n}_Overbought": flag(F.col(f"RSI_{n}") > 70), f"RSI_{n}_Oversold": flag(F.col(f"RSI_{n}") < 30),
                f"RSI_{n}_Neutral": flag(F.col(f"RSI_{n}").between(30, 70)),
            }.items()
        }),
    ])


def rsi(panel: DataFrame, periods=(14, 21)) -> DataFrame:
    return apply(panel, rsi_levels(periods))


def stochastic_levels(k_period=14, d_period=3) -> Indicator:
    low, high = rolling_min("low", k_period), rolling_max("high", k_period)
    k, d = F.col("Stoch_K"), F.col("Stoch_D")
    above = flag(k > d)
    return Indicator([
        Level({"Stoch_K": ratio(F.col("close") - low, high - low) * 100}),
        Level({"Stoch_D": rolling_mean("Stoch_K", d_period)}),
        Level({
            "Stoch_Overbought": flag((k > 80) & (d > 80)), "Stoch_Oversold": flag((k < 20) & (d < 20)),
            "Stoch_K_Above_D": above, "Stoch_Crossover": above - prev(above),
        }),
    ])


def stochastic(panel: DataFrame, k_period=14, d_period=3) -> DataFrame:
    return apply(panel, stochastic_levels(k_period, d_period))


def roc_levels(periods=(10, 20, 30)) -> Indicator:
    return Indicator([
        Level({f"ROC_{n}": ratio(F.col("close") - prev("close", n), prev("close", n)) * 100 for n in periods}),
        Level({
            name: cond for n in periods for name, cond in {
                f"ROC_{n}_Positive": flag(F.col(f"ROC_{n}") > 0), f"ROC_{n}_Strong_Positive": flag(F.col(f"ROC_{n}") > 5),
                f"ROC_{n}_Strong_Negative": flag(F.col(f"ROC_{n}") < -5),
            }.items()
        }),
    ])


def roc(panel: DataFrame, periods=(10, 20, 30)) -> DataFrame:
    return apply(panel, roc_levels(periods))


def williams_levels(periods=(14, 21)) -> Indicator:
    def value(n):
        high, low = rolling_max("high", n), rolling_min("low", n)
        return ratio(high - F.col("close"), high - low) * -100

    return Indicator([
        Level({f"Williams_R_{n}": value(n) for n in periods}),
        Level({
            name: cond for n in periods for name, cond in {
                f"Williams_R_{n}_Overbought": flag(F.col(f"Williams_R_{n}") > -20),
                f"Williams_R_{n}_Oversold": flag(F.col(f"Williams_R_{n}") < -80),
                f"Williams_R_{n}_Neutral": flag(F.col(f"Williams_R_{n}").between(-80, -20)),
            }.items()
        }),
    ])


def williams(panel: DataFrame, periods=(14, 21)) -> DataFrame:
    return apply(panel, williams_levels(periods))


def momentum_levels() -> list[Indicator]:
    return [rsi_levels(), stochastic_levels(), roc_levels(), williams_levels()]


def momentum(panel: DataFrame) -> DataFrame:
    return apply(panel, *momentum_levels())
