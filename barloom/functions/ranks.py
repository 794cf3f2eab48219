"""Exact quantiles and ranks that never put a whole group into one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Values per quantile that the sketch tells apart, and the width of a bracket in its errors.
ACCURACY, ERRORS = 1000, 2


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(at, value): every value of the columns as a double, with the column's number.

    Aggregates by ``at`` stay one small piece of code at any number of columns; one per column, side by side, are too large
    for the JIT beyond a few.
    """
    return df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("at", "value"))


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], finite: bool = False) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, of its finite values if so asked, by one path at every size.

    One sketch brackets each wanted quantile. Only the values inside a bracket, some thousandths of a
    column, are ranked exactly, range by range over many tasks; two numbers per quantile reach the driver.
    A bracket that misses its ranks is widened, at last to the whole column. ``df`` is read twice for each width: give
    it a written table where it is expensive.
    """
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    left = [(c, j) for c in out for j in range(len(probabilities))]
    width = ERRORS / ACCURACY
    while left:
        found = _ranked(df, left, probabilities, width, finite)
        for (c, j), q in found.items():
            out[c][j] = q
        left = [k for k in left if k not in found]
        width = width * 10 if width < 0.1 else 2.0
    return out


def _ranked(df: DataFrame, wanted: list[tuple[str, int]], probabilities: list[float], width: float, finite: bool) -> dict[tuple[str, int], float | None]:
    """{(column, number of the probability): quantile} for those whose bracket holds both ranks around them."""
    known = F.abs("value") < float("inf") if finite else F.col("value").isNotNull()
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + side * width))) for p in probabilities for side in (-1, 1)])
    columns = list(dict.fromkeys(c for c, _ in wanted))
    sketches = cells(df, columns).where(known).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("value", ends, ACCURACY).alias("ends")
    )
    sketched = {columns[r["at"]]: r for r in sketches.collect()}
    found: dict[tuple[str, int], float | None] = {k: None for k in wanted if k[0] not in sketched}
    wanted = [k for k in wanted if k[0] in sketched]
    if not wanted:
        return found
    lows, highs, ranks = [], [], []
    for c, j in wanted:
        n, p = sketched[c]["n"], probabilities[j]
        # Of few values all are ranked. NaN is beyond every number.
        few = n * width < 10
        lows.append(float("-inf") if few or p <= width else sketched[c]["ends"][2 * j])
        highs.append(float("nan") if few or p + width >= 1 else sketched[c]["ends"][2 * j + 1])
        ranks.append((n - 1) * p)

    def end(values):
        return F.array(*[F.lit(v) for v in values])[F.col("at")]

    # Values below a bracket are counted as one, those above it are left out.
    value = F.when(F.col("value") >= end(lows), F.col("value"))
    inside = (
        cells(df, [c for c, _ in wanted]).where(known).where(F.col("value") <= end(highs))
        .groupBy("at", value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    )
    inside = materialise(inside, "brackets")
    below = {r["at"]: r["rows"] for r in inside.where("value IS NULL").collect()}
    asked = sorted({(i, rank, rank - below.get(i, 0)) for i, h in enumerate(ranks) for rank in (math.floor(h), math.ceil(h))})
    table = df.sparkSession.createDataFrame(asked, "at int, rank long, place long")
    ranked = value_ranks(inside, ["at"], "value", count="rows").join(table, "at")
    hit = ranked.where((F.col("place") >= F.col("n_below")) & (F.col("place") < F.col("n_below") + F.col("n_equal")))
    at = {(r["at"], r["rank"]): r["value"] for r in hit.select("at", "rank", "value").collect()}
    for i, (k, h) in enumerate(zip(wanted, ranks)):
        low, high = at.get((i, math.floor(h))), at.get((i, math.ceil(h)))
        if low is not None and high is not None:
            found[k] = low if low == high else low + (high - low) * (h - math.floor(h))
    return found


def value_ranks(df: DataFrame, keys: list[str], value: str, slices: int = 64, count: str | None = None) -> DataFrame:
    """Per distinct (keys, value): n_equal, n_below and n_total of its group. A row stands for ``count`` rows, or one.

    Rows are first reduced to distinct values. Each group is then cut into ``slices``
    value ranges by a sketch, ranked range by range, and shifted by the counts of the
    lower ranges, so one huge group is spread over many tasks and the result is exact.
    A sketch depends on the order in which its parts arrive, so the cuts are worked out once and written: ranks and
    shifts must see the same ranges.
    """
    values = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.sum(count) if count else F.count(F.lit(1))).alias("n_equal"))
    )
    cuts = values.groupBy(*keys).agg(
        F.percentile_approx(
            value, F.array(*[F.lit(i / slices) for i in range(1, slices)]), 10_000
        ).alias("_cuts")
    )
    cuts = materialise(cuts, "cuts")
    sliced = values.join(cuts, keys).withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("n_equal").alias("_n"))
        .withColumn(
            "_shift",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .withColumn("n_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .drop("_n")
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_b", F.coalesce(F.sum("n_equal").over(within), F.lit(0)))
        .join(offsets, [*keys, "_slice"])
        .select(*keys, value, "n_equal", (F.col("_b") + F.col("_shift")).alias("n_below"), "n_total")
    )
