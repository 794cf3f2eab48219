"""Helpers shared by the query registrations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, folder) under name, with its comparison SQL when there is one."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def nudge(digits: int) -> float:
    """Moves decimal fractions off the rounding ties, where engines disagree."""
    return float(f"1.31415e-{digits + 1}")


def rounded(c, digits: int):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(nudge(digits)), digits)


def near(expression: str, digits: int) -> str:
    """SQL twin of ``rounded``."""
    return f"round(({expression}) + {nudge(digits)!r}::DOUBLE, {digits})"


def shown(df: DataFrame, keys: list[str], digits: dict[str, int | None]) -> DataFrame:
    """keys plus the named columns; doubles rounded so both engines agree."""
    return df.select(
        *keys,
        *[F.col(c) if d is None else rounded(c, d).alias(c) for c, d in digits.items()],
    )
