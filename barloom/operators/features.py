"""Price, calendar and derived features, targets, and the full feature panel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import apply, staged
from ..functions.windows import ahead, flag, prev, ratio, relative_change
from . import momentum, trend, validate, volatility, volume

RETURN_HORIZONS = (1, 5, 10, 20, 30)
TARGET_HORIZONS = (10, 20)
CATEGORIES = {
    "trend": trend.trend_levels, "momentum": momentum.momentum_levels,
    "volatility": volatility.volatility_levels, "volume": volume.volume_levels,
}


def candles(panel: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    out = panel.withColumns({
        "Price_High_Low_Ratio": ratio(h, low), "Price_Close_Open_Ratio": ratio(c, o),
        "Price_Range": h - low, "Price_Range_Pct": ratio(h - low, c),
        "Body_Size": F.abs(c - o), "Upper_Shadow": h - F.greatest(c, o), "Lower_Shadow": F.least(c, o) - low,
    })
    return out.withColumn(
        "Body_Shadow_Ratio", ratio(F.col("Body_Size"), F.col("Upper_Shadow") + F.col("Lower_Shadow") + 1e-8)
    )


def returns(panel: DataFrame, horizons=RETURN_HORIZONS) -> DataFrame:
    return panel.withColumns({
        name: value for h in horizons for name, value in {
            f"Return_{h}D": relative_change("close", h), f"Log_Return_{h}D": F.ln(ratio(F.col("close"), prev("close", h))),
        }.items()
    })


def volume_ratios(panel: DataFrame) -> DataFrame:
    return panel.withColumns({
        "Volume_Price_Ratio": ratio("volume", "close"),
        "Volume_Range_Ratio": ratio(F.col("volume"), F.col("high") - F.col("low")),
    })


def price_gaps(panel: DataFrame) -> DataFrame:
    return panel.withColumns({
        "Gap_Up": flag(F.col("open") > prev("high")), "Gap_Down": flag(F.col("open") < prev("low")),
        "Gap_Size": F.col("open") - prev("close"),
    })


def basic(panel: DataFrame) -> DataFrame:
    return price_gaps(volume_ratios(returns(candles(panel))))


def targets(panel: DataFrame, horizons=TARGET_HORIZONS) -> DataFrame:
    """Future values h rows ahead. They look ahead: training sets use one as the target only."""
    out = panel.withColumn("dayofweek", F.weekday("date"))
    return out.withColumns({
        name: value for h in horizons for name, value in {
            f"Future_High_{h}D": ahead("high", h), f"Future_Close_{h}D": ahead("close", h),
            f"Target_Date_{h}D": ahead("date", h),
        }.items()
    })


def all_features(panel: DataFrame, categories=tuple(CATEGORIES), drop_invalid_category: bool = False) -> DataFrame:
    """Every chosen category on one panel, level by level; all windows share one exchange.

    With drop_invalid_category a category is set to null for tickers whose columns of it
    score below 50 or hold an infinite value.
    """
    levels = {c: CATEGORIES[c]() for c in categories}
    indicators = [x for xs in levels.values() for x in xs]
    if indicators and not drop_invalid_category:
        out, found = staged(panel, *indicators)
        scratch = set(out.columns) - set(panel.columns)
        out = targets(basic(out))
        rest = [c for c in out.columns if c not in scratch and c not in panel.columns]
        return out.select(*panel.columns, *[c.alias(n) for n, c in found.items()], *rest)
    out = apply(panel, *indicators) if indicators else panel
    if drop_invalid_category:
        for xs in levels.values():
            added = [n for x in xs for n in x.outputs]
            good = validate.category_quality(out, added).where(
                (F.col("quality_score") >= 50) & (F.col("has_infinite") == 0)
            ).select("ticker", F.lit(True).alias("_good"))
            out = out.join(good, "ticker", "left").withColumns(
                {c: F.when(F.col("_good"), F.col(c)) for c in added}
            ).drop("_good")
    return targets(basic(out))


def price_normalised(df: DataFrame) -> DataFrame:
    """Ratios of the close to price-like columns present in df."""
    names, close = df.columns, F.col("close")
    new = {f"{c}_Ratio": ratio(close, F.col(c)) for c in names if c.startswith("SMA_")}
    if {"BB_Lower", "BB_Upper"} <= set(names):
        new["BB_Position"] = ratio(close - F.col("BB_Lower"), F.col("BB_Upper") - F.col("BB_Lower"))
    elif {"BB_Lower", "BB_Width"} <= set(names):
        new["BB_Upper"] = F.col("BB_Lower") + F.col("BB_Width")
        new["BB_Position"] = ratio(close - F.col("BB_Lower"), F.col("BB_Width"))
    if "ATR" in names:
        new["Price_ATR_Ratio"] = ratio("close", "ATR")
    if {"volume", "Return_1D"} <= set(names):
        new["Return_Volume_Efficiency"] = ratio(F.abs("Return_1D"), F.col("volume") + 1e-8)
    flags = ("_Above_Kijun", "_Above_Cloud", "_Below_Cloud", "_Green", "_Thickness")
    new |= {f"{c}_Ratio": ratio(close, F.col(c)) for c in names if c.startswith("Ichimoku_") and not c.endswith(flags)}
    if "open" in names:
        new["Close_Open_Ratio"] = ratio("close", "open")
    return df.withColumns(new)


def prediction_bounds(df: DataFrame) -> DataFrame:
    names, new = set(df.columns), {}
    if "ATR_Percent" in names:
        new["Expected_Daily_Move"] = F.col("ATR_Percent")
        new["Expected_10D_Move"] = F.col("ATR_Percent") * math.sqrt(10)
    if {"Vol_Regime_High", "Vol_Regime_Low"} <= names:
        new["Vol_Regime_Context"] = F.col("Vol_Regime_High") * 2 + F.col("Vol_Regime_Low") * 0.5
    if "RSI_14" in names:
        new["RSI_Mean_Reversion_Pressure"] = F.abs(F.col("RSI_14") - 50) / 50
    return df.withColumns(new) if new else df


def calendar(df: DataFrame, column: str = "date") -> DataFrame:
    d = F.col(column)
    end = F.last_day(d) == d
    return df.withColumns({
        "date_int": F.datediff(d, F.lit("2020-01-01").cast("date")),
        "year": F.year(d), "month": F.month(d), "day_of_year": F.dayofyear(d), "quarter": F.quarter(d),
        "day_of_week": F.weekday(d), "is_month_end": end.cast("int"),
        "is_quarter_end": (end & (F.month(d) % 3 == 0)).cast("int"),
    })


def return_target(df: DataFrame, horizon: int = 10) -> tuple[DataFrame, str]:
    """Adds the relative return to the future close (or the first future high column).

    Returns above 1.0 or below -0.7 are dropped; rows without a return are kept.
    """
    source, name = f"Future_Close_{horizon}D", f"Future_Return_{horizon}D"
    if source not in df.columns:
        highs = [c for c in df.columns if c.startswith("Future_High_")]
        if not highs:
            raise ValueError(f"no target column: expected {source} or a Future_High_ column")
        source, name = highs[0], highs[0].replace("Future_High_", "Future_Return_")
    if "close" not in df.columns:
        raise ValueError("close is required for a return target")
    value = F.when(F.abs("close") > 1e-12, ratio(F.col(source) - F.col("close"), F.col("close")))
    out = df.withColumn(name, value)
    return out.where(F.col(name).isNull() | F.col(name).between(-0.7 - 1e-9, 1.0 + 1e-9)), name


def to_price(predicted, current, bounded: bool = False, max_daily_move: float = 10.0):
    """Return to price; bounded clamps to the ten-day move around the current price."""
    price = current * (1 + predicted)
    if not bounded:
        return price
    reach = max_daily_move * math.sqrt(10) / 100
    return F.least(F.greatest(price, current * (1 - reach)), current * (1 + reach))


def long_features(panel: DataFrame, columns: list[str], quality: DataFrame | None = None) -> DataFrame:
    """(ticker, date, category, name, value): missing, infinite and huge values are dropped."""
    category = F.create_map(*[F.lit(x) for c in columns for x in (c, validate.category_of(c))])
    out = (
        panel.select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(["ticker", "date"], columns, "feature_name", "feature_value")
        .where(F.abs("feature_value") < 1e9)
        .withColumn("feature_category", category[F.col("feature_name")])
    )
    return out.join(quality, "ticker", "left") if quality is not None else out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def batch_results(bars: DataFrame, min_bars: int = 200, max_missing: float = 0.05) -> DataFrame:
    """Per ticker of a batch: status, number of rows, and why it was left out."""
    checks = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("records"),
        F.greatest(*[F.avg(F.col(c).isNull().cast("int")) for c in validate.OHLCV]).alias("missing"),
    )
    error = F.when(F.col("records") < min_bars, "insufficient_data").when(F.col("missing") > max_missing, "too_many_missing")
    return checks.select(
        "ticker", "records", F.when(error.isNull(), "success").otherwise("failed").alias("status"), error.alias("error")
    )


def feature_batch(bars: DataFrame, tickers: DataFrame, min_bars: int = 200) -> DataFrame:
    """One job over all eligible tickers: guard, clean, all features."""
    from .ingest import eligible_tickers

    chosen = bars.join(eligible_tickers(bars, tickers, min_bars).select("ticker"), "ticker", "left_semi")
    return all_features(validate.enough_data(validate.clean_series(chosen), min_bars))
