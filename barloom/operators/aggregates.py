"""Small reports over bars and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def true_vwap(bars: DataFrame, digits: int | None = 4) -> DataFrame:
    """Sum of typical price times volume over total volume, of positive rows; 0 without any."""
    ok = (F.col("volume") > 0) & (F.least("high", "low", "close") > 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")
    value = F.try_divide(F.sum(F.when(ok, typical)), F.sum(F.when(ok, F.col("volume"))).cast("double"))
    if digits is not None:
        value = F.round(value, digits)
    return bars.groupBy("ticker").agg(F.coalesce(value, F.lit(0.0)).alias("vwap"))


def run_statistics(results: DataFrame) -> DataFrame:
    """Totals over a per-ticker result frame (ticker, status, total_features, records)."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("status") == "success")
    return results.agg(
        n.alias("processed"), ok.alias("successful"), (n - ok).alias("failed"),
        F.coalesce(F.try_divide(ok.cast("double") * 100, n.cast("double")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
    )
