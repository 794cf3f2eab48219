"""Volume indicators.

OBV: cumulative volume, minus where the close fell and plus otherwise. VPT: cumulative
relative close change times volume (null on the first row). A/D line: cumulative close
location value times volume, 0 on a zero range. MFI: 14-row ratio of money flow by the
direction of the typical price; 100 when nothing flowed out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.smoothing import adjusted_ema
from ..functions.staging import Indicator, Level, apply
from ..functions.windows import (
    both, flag, history, last_rows, prev, ratio, relative_change, rolling, rolling_max, rolling_mean, rolling_min,
    rolling_std, running_sum,
)


def _line_levels(base: str, prefix: str) -> list[Level]:
    """Averages, direction and momentum shared by the cumulative lines."""
    x = F.col(base)
    return [
        Level({
            f"{prefix}_SMA_10": rolling_mean(base, 10), f"{prefix}_SMA_20": rolling_mean(base, 20),
            f"{prefix}_Rising": flag(x > prev(base)), f"{prefix}_Falling": flag(x < prev(base)),
            f"{prefix}_Momentum_5": x - prev(base, 5), f"{prefix}_Momentum_10": x - prev(base, 10),
        }),
        Level({f"{prefix}_Above_SMA_{n}": flag(x > F.col(f"{prefix}_SMA_{n}")) for n in (10, 20)}),
    ]


def _relative_over(col: str, h: int):
    """Sign-faithful change over h rows: +-infinity from a zero base is kept as its sign."""
    now, then = F.col(col).cast("double"), prev(col, h).cast("double")
    return F.when(then == 0, F.when(now != 0, F.signum(now) * float("inf"))).otherwise(
        F.try_divide(now - then, then)
    )


def _divergence(price_change, other_change):
    return flag(
        ((price_change > 0) & (other_change < 0)) | ((price_change < 0) & (other_change > 0))
    )


def obv_levels() -> Indicator:
    signed = F.when(F.col("close") < prev("close"), -F.col("volume")).otherwise(F.col("volume"))
    line, above = _line_levels("OBV", "OBV")
    line.columns |= {"OBV_Price_Divergence": _divergence(F.col("_pc5"), _relative_over("OBV", 5))}
    return Indicator([
        Level({"_signed": signed, "_pc5": relative_change("close", 5)}),
        Level({"OBV": running_sum(F.col("_signed")).cast("double")}), line, above,
    ])


def obv(panel: DataFrame) -> DataFrame:
    return apply(panel, obv_levels())


def vpt_levels() -> Indicator:
    line, above = _line_levels("VPT", "VPT")
    line.columns |= {f"VPT_ROC_{h}": ratio(F.col("VPT") - prev("VPT", h), prev("VPT", h)) * 100 for h in (5, 10)}
    return Indicator([
        Level({"_flow": relative_change("close") * F.col("volume")}), Level({"VPT": running_sum(F.col("_flow"))}), line, above,
    ])


def vpt(panel: DataFrame) -> DataFrame:
    """ROC columns are null where the earlier value is 0."""
    return apply(panel, vpt_levels())


def ad_levels() -> Indicator:
    place = F.coalesce(
        ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low")), F.lit(0.0)
    )
    line, above = _line_levels("AD_Line", "AD")
    swing = F.col("AD_Line") - F.col("_ad_ema")
    line.columns |= {"AD_Oscillator": swing, "AD_Oscillator_Above_Zero": flag(swing > 0)}
    return Indicator([
        Level({"AD_Line": running_sum(place * F.col("volume"))}, [adjusted_ema("_ad_ema", "AD_Line", 2 / 11)], ["AD_Line"]), line, above,
    ])


def ad_line(panel: DataFrame) -> DataFrame:
    return apply(panel, ad_levels())


def profile_levels(periods=(10, 20, 50)) -> Indicator:
    v = F.col("volume")
    return Indicator([
        Level({
            name: value for n in periods for name, value in {
                f"Volume_MA_{n}": rolling_mean("volume", n), f"_first_{n}": prev("volume", n - 1)}.items()
        }),
        Level({
            name: value for n in periods for name, value in {
                f"Volume_Ratio_{n}": ratio(v, F.col(f"Volume_MA_{n}")),
                f"High_Volume_{n}": flag(v > F.col(f"Volume_MA_{n}") * 1.5), f"Low_Volume_{n}": flag(v < F.col(f"Volume_MA_{n}") * 0.5),
                f"Volume_Trend_{n}": flag((v > F.col(f"_first_{n}")) & F.col(f"Volume_MA_{n}").isNotNull()),
            }.items()
        }),
    ])


def volume_profile(panel: DataFrame, periods=(10, 20, 50)) -> DataFrame:
    return apply(panel, profile_levels(periods))


def price_volume_levels(min_rows=20) -> Indicator:
    pc, vc, enough = F.col("_pc1"), F.col("_vc1"), F.col("_enough")
    busy = F.col("volume") > F.col("_vm10")

    def correlation(n):
        # The correlation is spelled out: the built-in divides by zero on a flat frame.
        pair = both(pc, vc, lambda a, b: a)
        w = last_rows(n)
        spread = F.stddev_pop(pair).over(w) * F.stddev_pop(vc).over(w)
        return F.when(enough & (F.count(pair).over(w) == n), F.try_divide(F.covar_pop(pc, vc).over(w), spread))

    return Indicator([
        Level({
            "_pc1": relative_change("close"), "_vc1": relative_change("volume"), "_vm10": rolling_mean("volume", 10),
            "_enough": history() >= min_rows,
        }),
        Level({
            "PV_Correlation_10": correlation(10), "PV_Correlation_20": correlation(20),
            "Volume_Confirms_Uptrend": flag(enough & (pc > 0) & busy), "Volume_Confirms_Downtrend": flag(enough & (pc < 0) & busy),
            "Volume_Divergence": flag(enough & (((pc > 0) & (vc < 0)) | ((pc < 0) & (vc > 0)))),
        }),
    ])


def price_volume(panel: DataFrame, min_rows=20) -> DataFrame:
    return apply(panel, price_volume_levels(min_rows))


def position_levels(window=50) -> Indicator:
    v = F.col("volume")
    low, high = rolling_min("volume", window), rolling_max("volume", window)
    mean, sd = rolling_mean("volume", window), rolling_std("volume", window)
    return Indicator([Level({
        f"Volume_Percentile_{window}": F.when(low.isNotNull(), F.coalesce(ratio(v - low, high - low), F.lit(0.5))),
        "Volume_Regime_High": flag(v > mean + sd * 2), "Volume_Regime_Low": flag(v < mean - sd),
    })])


def volume_position(panel: DataFrame, window=50) -> DataFrame:
    return apply(panel, position_levels(window))


def money_flow_levels(period=14) -> Indicator:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    amount, pos, neg, m = tp * F.col("volume"), F.col("_pos"), F.col("_neg"), F.col("MFI")
    return Indicator([
        Level({
            "_in": F.when(tp > prev(tp), amount).otherwise(0.0), "_out": F.when(tp < prev(tp), amount).otherwise(0.0),
            "_pc5": relative_change("close", 5),
        }),
        Level({"_pos": rolling(F.sum, "_in", period), "_neg": rolling(F.sum, "_out", period)}),
        Level({"MFI": F.when(neg == 0, F.when(pos > 0, 100.0)).otherwise(100 - 100 / (1 + ratio(pos, neg)))}),
        Level({
            "MFI_Overbought": flag(m > 80), "MFI_Oversold": flag(m < 20), "MFI_Neutral": flag(m.between(20, 80)),
            "MFI_Rising": flag(m > prev("MFI")), "MFI_Falling": flag(m < prev("MFI")),
            "MFI_Momentum_5": m - prev("MFI", 5), "MFI_Momentum_10": m - prev("MFI", 10),
            "MFI_Price_Divergence": _divergence(F.col("_pc5"), _relative_over("MFI", 5)),
        }),
    ])


def money_flow(panel: DataFrame, period=14) -> DataFrame:
    return apply(panel, money_flow_levels(period))


def volume_levels() -> list[Indicator]:
    return [obv_levels(), vpt_levels(), ad_levels(), profile_levels(), price_volume_levels(), position_levels(), money_flow_levels()]


def volume(panel: DataFrame) -> DataFrame:
    return apply(panel, *volume_levels())
