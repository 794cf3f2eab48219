"""Indicators as levels of columns, so that many of them share each pass over the panel.

An indicator is a list of levels; a level may use the columns of the levels before it. All
indicators of a call are applied level by level: one projection, hence one window operator
and one smoothing step per level, however many indicators take part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .smoothing import Recurrence, smooth


@dataclass
class Level:
    columns: dict[str, Column] = field(default_factory=dict)
    smoothed: list[Recurrence] = field(default_factory=list)
    inputs: list[str] = field(default_factory=list)


@dataclass
class Indicator:
    """Columns starting with an underscore are scratch and do not come out."""

    levels: list[Level]

    @property
    def outputs(self) -> list[str]:
        names = [n for lv in self.levels for n in [*lv.columns, *(m.out for m in lv.smoothed)]]
        return [n for n in names if not n.startswith("_")]


#: Fewer finished columns than this are not worth a struct.
PACK = 4


def _texts(level: Level) -> list[str]:
    """What a level is made of, as text: its columns, recurrences and inputs."""
    parts = [*level.columns.values(), *(c for m in level.smoothed for c in (m.drive, m.shown, m.scale, m.loss, m.plain) if c is not None)]
    return [*map(str, parts), *level.inputs]


def _names(texts: list[str]) -> set[str]:
    return {word for text in texts for word in re.findall(r"\w+", text)}


def staged(panel: DataFrame, *indicators: Indicator) -> tuple[DataFrame, dict[str, Column]]:
    """The panel with all outputs, and by name where each output is found.

    Rows pass through a window and a sort per level. Outputs that no later level reads go into one struct, which is copied
    as a whole; as separate columns, each would be read and written again on every pass. The caller selects what it wants.
    """
    depth = max(len(x.levels) for x in indicators)
    levels = [[x.levels[i] for x in indicators if i < len(x.levels)] for i in range(depth)]
    texts = [[t for lv in level for t in _texts(lv)] for level in levels]
    smoothing = [[t for lv in level for t in _texts(Level({}, lv.smoothed, lv.inputs))] for level in levels]
    outputs, out = {n for x in indicators for n in x.outputs}, panel
    found: dict[str, Column] = {}
    made: list[str] = []

    def pack(later: list[str]) -> None:
        nonlocal out, made
        read = _names(later)
        done = [n for n in made if n not in read and n in outputs]
        if len(done) >= PACK:
            name = f"_done_{len(found)}"
            # A path tells the struct's fields from columns of the same names.
            found.update({n: F.col(f"{name}.{n}") for n in done})
            out = out.withColumn(name, F.struct(*done)).drop(*done)
            made = [n for n in made if n not in done]

    for i, level in enumerate(levels):
        columns = {n: c for lv in level for n, c in lv.columns.items()}
        if columns:
            out = out.withColumns(columns)
            made += [n for n in columns if n not in panel.columns]
            pack([*smoothing[i], *(t for later in texts[i + 1 :] for t in later)])
        items = {m.out: m for lv in level for m in lv.smoothed}
        if items:
            out = smooth(out, list(items.values()), sorted({c for lv in level for c in lv.inputs}))
            made += [n for n in items if n not in panel.columns]
            pack([t for later in texts[i + 1 :] for t in later])
    return out, {n: found.get(n, F.col(n)) for x in indicators for n in x.outputs}


def apply(panel: DataFrame, *indicators: Indicator) -> DataFrame:
    out, found = staged(panel, *indicators)
    return out.select(*panel.columns, *[c.alias(n) for n, c in found.items()])
