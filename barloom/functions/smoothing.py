"""Recursive smoothing (EMA, Wilder, seeded averages) without leaving the JVM.

Each smoother is the linear recurrence ``y[k] = a * y[k-1] + u[k]``. Spark windows
cannot refer to their own output, but the recurrence has a closed form inside a run of
L rows::

    y[r] = a^r * (a * y_end(previous run) + sum_{i<=r} u[i] * a^-i)

so one cumulative sum per run and one short fold over the run ends give the exact
value. L keeps ``a^-L`` far inside the range of a double. Both windows hash on the
ticker only, so they add sorts but no exchange.

Gaps: a row without a value shows the last result again. An EMA's older weight keeps falling over a gap and its
weights are made to sum to one again at the next value, as ``ewm(ignore_na=False)`` does; a seeded mean takes up where it
stopped. Both stay the same recurrence: rows of a gap drive nothing, and a scale, known from the
row numbers of the values alone, undoes the decay that the gap has not earned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import KEY, TIME, row_no, running_sum, so_far, timeline

RUN = 256


@dataclass(frozen=True)
class Recurrence:
    """``out = total / scale`` with ``total = decay * total[-1] + drive``; null where ``shown`` is false.

    ``loss`` is summed over the rows so far and offered to drive and scale as ``_g_<out>``.
    """

    out: str
    decay: float
    drive: Column
    shown: Column
    scale: Column | None = None
    loss: Column | None = None
    by_weights: bool = False
    plain: Column | None = None


def _there(col: str) -> Column:
    return F.col(col).isNotNull()


def ema(out: str, col: str, alpha: float, min_rows: int) -> Recurrence:
    """adjust=False: seeded with the first value, null for the first min_rows - 1 values."""
    seen, decay = F.col(f"_n_{col}"), 1.0 - alpha
    if decay <= 0:
        return Recurrence(out, 0.0, F.lit(0.0), seen >= min_rows, plain=F.last(col, ignorenulls=True).over(so_far()))
    gap = F.col("_rn") - F.col(f"_before_{col}")
    # The weights after a gap of several rows sum to less than one.
    loss = F.when(_there(col) & (gap > 1), F.log(F.pow(F.lit(decay), gap) + alpha)).otherwise(0.0)
    kept = F.exp(F.col(f"_g_{out}"))
    value = F.when(seen == 1, F.col(col)).otherwise(F.col(col) * alpha * F.exp(F.col(f"_g_{out}") - loss))
    scale = kept * F.pow(F.lit(decay), F.col("_rn") - F.col(f"_at_{col}"))
    return Recurrence(out, decay, F.when(_there(col), value), seen >= min_rows, scale, loss)


def adjusted_ema(out: str, col: str, alpha: float) -> Recurrence:
    """adjust=True: weights normalised by their sum, the same recurrence over ones."""
    return Recurrence(out, 1.0 - alpha, F.col(col), F.col(f"_n_{col}") >= 1, F.col(f"_d_{out}"), by_weights=True)


def weights_of(m: Recurrence) -> Recurrence:
    """The recurrence that an adjusted EMA divides by."""
    return Recurrence(f"_d_{m.out}", m.decay, F.when(m.drive.isNotNull(), 1.0), F.lit(True))


def seeded_mean(out: str, col: str, n: int) -> Recurrence:
    """Wilder average seeded with the mean of the first n values; 0 before the seed."""
    seen, decay = F.col(f"_n_{col}"), (n - 1) / n
    if n == 1:
        return Recurrence(out, 0.0, F.lit(0.0), F.lit(True), plain=F.coalesce(F.last(col, ignorenulls=True).over(so_far()), F.lit(0.0)))
    gaps = F.coalesce(F.col("_rn") - F.col(f"_first_{col}") + 1 - seen, F.lit(0))
    scale = F.pow(F.lit(decay), gaps)
    value = F.when(seen == n, F.col(f"_s_{col}") / n).when(seen > n, F.col(col) / n).otherwise(0.0)
    return Recurrence(out, decay, F.when(_there(col), value * scale), F.lit(True), scale)


def smooth(df: DataFrame, items: list[Recurrence], inputs: list[str], run: int = RUN) -> DataFrame:
    """Append the recurrences over ``inputs`` (columns of df) to the panel."""
    columns, shown_items = df.columns, items
    divisors = [weights_of(m) for m in items if m.by_weights]
    items = [*divisors, *items]
    earlier = timeline().rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumns(
        {"_rn": row_no()}
        | {f"_n_{c}": running_sum(F.when(F.col(c).isNotNull(), 1).otherwise(0)) for c in inputs}
        | {f"_s_{c}": running_sum(F.col(c)) for c in inputs}
    )
    counted = counted.withColumns(
        {"_run": F.floor((F.col("_rn") - 1) / run), "_r": (F.col("_rn") - 1) % run}
        | {f"_{name}_{c}": fn(F.when(_there(c), F.col("_rn"))).over(w)
           for c in inputs for name, fn, w in (("before", F.max, earlier), ("at", F.max, so_far()), ("first", F.min, so_far()))}
    )
    if losses := {f"_g_{m.out}": running_sum(m.loss) for m in items if m.loss is not None}:
        counted = counted.withColumns(losses)
    in_run = (
        Window.partitionBy(KEY, "_run").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    )
    recursive = [m for m in items if m.plain is None]
    local = counted.withColumns(
        {
            f"_l_{m.out}": F.sum(
                F.coalesce(m.drive, F.lit(0.0)) * F.pow(F.lit(m.decay), -F.col("_r"))
            ).over(in_run)
            for m in recursive
        }
    )
    before = timeline().rowsBetween(Window.unboundedPreceding, -1)
    carried = local.withColumns(
        {
            f"_c_{m.out}": F.collect_list(
                F.when(F.col("_r") == run - 1, F.col(f"_l_{m.out}") * (m.decay ** (run - 1)))
            ).over(before)
            for m in recursive
        }
    )

    def value(m: Recurrence) -> Column:
        whole_run = m.decay**run
        carry = F.aggregate(f"_c_{m.out}", F.lit(0.0), lambda acc, e: acc * whole_run + e)
        return F.pow(F.lit(m.decay), F.col("_r")) * (carry * m.decay + F.col(f"_l_{m.out}"))

    results = carried.withColumns({m.out: value(m) for m in divisors}) if divisors else carried

    def shown(m: Recurrence) -> Column:
        if m.plain is not None:
            return F.when(m.shown, m.plain)
        return F.when(m.shown, value(m) if m.scale is None else value(m) / m.scale)

    return results.withColumns({m.out: shown(m) for m in shown_items}).select(
        *columns, *[m.out for m in shown_items]
    )
