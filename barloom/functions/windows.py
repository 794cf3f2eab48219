"""Rolling, cumulative and shifted columns over a (ticker, date) panel.

Every window partitions by ticker. The panel holds at most one row per ticker and
calendar day (``merge.dedupe_bars`` guarantees it), so a partition is bounded by the
length of the calendar, never by the size of the data set. All helpers share one
partitioning, so a whole stack of them costs one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEY = "ticker"
TIME = "date"


def timeline():
    return Window.partitionBy(KEY).orderBy(TIME)


def last_rows(n: int):
    return timeline().rowsBetween(-(n - 1), 0)


def so_far():
    return timeline().rowsBetween(Window.unboundedPreceding, 0)


def whole():
    return Window.partitionBy(KEY)


def rolling(fn, col, n: int) -> Column:
    """fn over the last n rows; null until n non-null values are in the frame."""
    col = F.col(col) if isinstance(col, str) else col
    w = last_rows(n)
    return F.when(F.count(col).over(w) == n, fn(col).over(w))


def rolling_mean(col, n):
    return rolling(F.avg, col, n)


def rolling_max(col, n):
    return rolling(F.max, col, n)


def rolling_min(col, n):
    return rolling(F.min, col, n)


def rolling_std(col, n):
    return rolling(F.stddev_samp, col, n)


def rolling_sorted(col, n):
    """The values of the last n rows in ascending order; null until n non-null values are in the frame."""
    values = F.collect_list(col).over(last_rows(n))
    return F.when(F.size(values) == n, F.sort_array(values))


def quantile_of(values, n, q):
    """Exact, linearly interpolated quantile of n sorted values; several quantiles can share one ``rolling_sorted``."""
    values = F.col(values) if isinstance(values, str) else values
    place = (n - 1) * q
    low, high = math.floor(place), math.ceil(place)
    a, b = values[low], values[high]
    return a if low == high else F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)


def prev(col, h: int = 1) -> Column:
    return F.lag(col, h).over(timeline())


def ahead(col, h: int = 1) -> Column:
    return F.lead(col, h).over(timeline())


def running_sum(col) -> Column:
    return F.sum(col).over(so_far())


def row_no() -> Column:
    return F.row_number().over(timeline())


def history() -> Column:
    """Number of rows the ticker has."""
    return F.count(F.lit(1)).over(whole())


def flag(cond: Column) -> Column:
    """0/1; an unknown condition counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def both(a, b, pick) -> Column:
    """pick(a, b), null when either is null (greatest/least skip nulls)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


def ratio(a, b) -> Column:
    """a / b, null on a zero denominator."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def relative_change(col: str, h: int = 1) -> Column:
    return ratio(F.col(col), prev(col, h)) - 1


def add(df, columns: dict):
    return df.withColumns(columns)
