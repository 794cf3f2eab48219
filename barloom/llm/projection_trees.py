"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors of one label are one class, and classes stand for their vectors. In every tree a group of vectors
is split at the median of a random projection, again and again, until a leaf is small. Vectors close to a split
go to both sides, so close pairs part only if they straddle the whole overlap. The upper splits of each label are fitted
on a bounded sample and route every vector; what reaches a routed leaf is split on within its task. Vectors are
compared within leaves only, in double precision. A pair counts in the first tree and leaf that holds both, so
link counts are exact for all pairs found; each leaf returns a tree of its links, not all pairs.

The overlap is ``REACH`` times the standard deviation that the projected difference of a pair at the threshold has;
with several trees practically every pair meets in some leaf (tests measure the recall).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a
null label or vec_id, link with nothing; vectors of different lengths do not link; repeated rows of one vec_id are one
vector (the first of its values in order) and return a row each; an empty table gives no rows. A null vec_id has no component and is
kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.shared import materialise
from barloom.llm.components import components

TREES = 4
#: Vectors of a leaf, about, and of a routed leaf at the sample's scale.
LEAF, ROUTED = 256, 20_000
#: Sampled vectors per label at most, for the splits that route.
SAMPLE = 20_000
REACH = 2.0
#: More than a routed leaf has small leaves.
LEAVES = 1 << 24
#: More than a tree has leaves.
FOREST = 1 << 56
DEPTH = 40


def direction(seed: int, size: int) -> np.ndarray:
    found = np.random.default_rng(seed).standard_normal(size)
    return found / np.linalg.norm(found)


def overlap(threshold: float, size: int) -> float:
    """Half the width of the zone that goes to both sides."""
    return REACH * math.sqrt(2 - 2 * threshold) / math.sqrt(size) / 2


def splits(points: np.ndarray, rows: np.ndarray, seed: int, least: int, margin: float, depth: int = 0) -> Iterator[tuple]:
    """(path, rows) of the leaves; a split that does not thin out its group enough ends there."""
    if len(rows) <= least or depth >= DEPTH:
        yield seed, rows
        return
    projected = points[rows] @ direction(seed, points.shape[1])
    middle = np.median(projected)
    left, right = rows[projected <= middle + margin], rows[projected > middle - margin]
    if max(len(left), len(right)) > 0.9 * len(rows):
        yield seed, rows
        return
    yield from splits(points, left, 2 * seed, least, margin, depth + 1)
    yield from splits(points, right, 2 * seed + 1, least, margin, depth + 1)


def fitted(points: np.ndarray, tree: int, parts: int, margin: float) -> dict[int, float]:
    """Medians of the splits that cut the sample into about ``parts`` parts, by node."""
    out: dict[int, float] = {}

    def go(node: int, rows: np.ndarray, depth: int):
        if 1 << depth >= parts or len(rows) < 32:
            return
        projected = points[rows] @ direction(tree * 1_000_003 + node, points.shape[1])
        out[node] = float(np.median(projected))
        go(2 * node, rows[projected <= out[node]], depth + 1)
        go(2 * node + 1, rows[projected > out[node]], depth + 1)

    go(1, np.arange(len(points)), 0)
    return out


def routes(points: np.ndarray, tree: int, medians: dict[int, float], margin: float) -> list[list[int]]:
    """The routed leaves of every point."""
    out: list[list[int]] = [[] for _ in range(len(points))]
    waiting = [(1, np.arange(len(points)))]
    while waiting:
        node, rows = waiting.pop()
        if node not in medians:
            for r in rows.tolist():
                out[r].append(node)
            continue
        projected = points[rows] @ direction(tree * 1_000_003 + node, points.shape[1])
        waiting.append((2 * node, rows[projected <= medians[node] + margin]))
        waiting.append((2 * node + 1, rows[projected > medians[node] - margin]))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of doubles) of the vectors that can link, one row per vec_id."""
    kept = vectors.where("vec_id is not null").groupBy("vec_id").agg(
        F.min(F.struct("label", F.col("embedding").cast("array<double>").alias("v"))).alias("one")
    )
    kept = kept.select("vec_id", "one.label", "one.v").where("label is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return kept.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _matrix(values) -> np.ndarray:
    """Unit vectors; scaled first, so that no square overflows or vanishes."""
    points = np.array(values.tolist() if hasattr(values, "tolist") else values, dtype=np.float64)
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n members' component."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            break
    return low


def cut(frame: pd.DataFrame, tree: int, threshold: float) -> pd.DataFrame:
    """vec_id, leaf: the small leaves of what reached a routed leaf. Leaves are numbered through all trees."""
    frame = frame.sort_values("vec_id").reset_index(drop=True)
    points, node = _matrix(frame["v"]), int(frame["node"].iat[0])
    margin = overlap(threshold, points.shape[1])
    found = list(splits(points, np.arange(len(frame)), tree * 7919 + node + 1, LEAF, margin))
    rows = np.concatenate([rows for _, rows in found])
    numbers = np.repeat(np.arange(len(found)), [len(rows) for _, rows in found])
    return pd.DataFrame({"vec_id": frame["vec_id"].to_numpy()[rows], "leaf": tree * FOREST + node * LEAVES + numbers})


def compared(frame: pd.DataFrame, leaf: int, threshold: float, rows: int = 2048) -> pd.DataFrame:
    """vec_id, n_links (links that no leaf with a smaller number counts), low (smallest linked vec_id here) of a leaf."""
    frame = frame.sort_values("vec_id").reset_index(drop=True)
    points = _matrix(frame["v"])
    ids, copies = frame["vec_id"].to_numpy(), frame["copies"].to_numpy()
    counts = np.zeros(len(frame), dtype=np.int64)
    edges_a, edges_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    # Which vectors also lie in which leaf with a smaller number: a pair with such a leaf in common counts there.
    lengths = [len(found) for found in frame["places"]]
    places = np.concatenate(list(frame["places"]))
    row = np.repeat(np.arange(len(frame)), lengths)[places < leaf]
    codes, column = np.unique(places[places < leaf], return_inverse=True)
    before = np.zeros((len(frame), len(codes)), dtype=np.float32)
    before[row, column] = 1
    for start in range(0, len(frame), rows):
        dots = points[start : start + rows] @ points.T
        a, b = np.nonzero(dots >= threshold - 1e-9)
        keep = a + start < b
        a, b = a[keep], b[keep]
        unsure = dots[a, b] < threshold + 1e-9
        a = a + start
        linked = np.ones(len(a), dtype=bool)
        linked[unsure] = np.einsum("ij,ij->i", points[a[unsure]], points[b[unsure]]) >= threshold
        fresh = linked & ((before[start : start + rows] @ before.T)[a - start, b] == 0)
        a, b = a[fresh], b[fresh]
        counts += np.bincount(a, copies[b], len(frame)).astype(np.int64) + np.bincount(b, copies[a], len(frame)).astype(np.int64)
        # A spanning forest is enough for the components.
        low = roots(len(frame), a, b)
        joined = np.flatnonzero(low != np.arange(len(frame)))
        edges_a.append(joined)
        edges_b.append(low[joined])
    low = roots(len(frame), np.concatenate(edges_a), np.concatenate(edges_b))
    found = (counts > 0) | (low != np.arange(len(frame)))
    return pd.DataFrame({"vec_id": ids[found], "n_links": counts[found], "low": ids[low[found]]})


def links(classes: DataFrame, threshold: float, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, low of the classes (vec_id, label, v, copies) per tree and routed leaf."""
    kind = classes.schema["vec_id"].dataType.simpleString()
    labels = classes.groupBy("label", F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sized = classes.withColumn("size", F.size("v")).join(labels, ["label", "size"])

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(frame["v"])
        parts = max(1, -(-int(frame["n"].iat[0]) // ROUTED))
        margin = overlap(threshold, points.shape[1])
        made = [fitted(points, t, parts, margin) for t in range(trees)]
        return pd.DataFrame(
            {
                "label": [key[0]],
                "size": [key[1]],
                "nodes": [[list(m) for m in made]],
                "medians": [[list(m.values()) for m in made]],
            }
        )

    kinds = {f.name: f.dataType.simpleString() for f in sized.schema}
    models = (
        sized.where(draw < share)
        .groupBy("label", "size")
        .applyInPandas(
            fit, f"label {kinds['label']}, size int, nodes array<array<long>>, medians array<array<double>>"
        )
    )

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            found: list = [None] * len(frame)
            for _, rows in frame.groupby(["label", "size"]).indices.items():
                points = _matrix(frame["v"].iloc[rows])
                margin = overlap(threshold, points.shape[1])
                one = frame.iloc[rows[0]]
                nodes, medians = one["nodes"], one["medians"]
                by_tree = [
                    routes(points, t, dict(zip(nodes[t], medians[t])) if nodes is not None else {}, margin) for t in range(trees)
                ]
                for k, r in enumerate(rows):
                    found[r] = [by_tree[t][k] for t in range(trees)]
            frame["leaves"] = found
            yield frame[["vec_id", "label", "size", "v", "copies", "leaves"]]

    routed = sized.join(models, ["label", "size"], "left").select("vec_id", "label", "size", "v", "copies", "nodes", "medians")
    routed = materialise(
        routed.mapInPandas(
            route,
            f"vec_id {kind}, label {kinds['label']}, size int, v array<double>, copies long, leaves array<array<long>>",
        ),
        "routed",
    )
    reached = routed.select("*", F.posexplode("leaves").alias("tree", "nodes")).withColumn("node", F.explode("nodes"))

    def cut_leaf(key, frame: pd.DataFrame) -> pd.DataFrame:
        return cut(frame, int(key[0]), threshold)

    cuts = reached.drop("nodes", "leaves").groupBy("tree", "label", "size", "node")
    cuts = cuts.applyInPandas(cut_leaf, f"vec_id {kind}, leaf long")
    places = cuts.groupBy("vec_id").agg(F.collect_list("leaf").alias("places"))
    placed = materialise(routed.drop("leaves").join(places, "vec_id"), "placed")

    def compare_leaf(key, frame: pd.DataFrame) -> pd.DataFrame:
        return compared(frame, int(key[2]), threshold)

    in_leaves = placed.withColumn("leaf", F.explode("places")).groupBy("label", "size", "leaf")
    return in_leaves.applyInPandas(compare_leaf, f"vec_id {kind}, n_links long, low {kind}")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    good = materialise(usable(vectors), "vectors")
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "vector-classes")
    members = good.join(classes, ["label", "v"]).select("vec_id", "rep", "copies")
    reps = classes.select(F.col("rep").alias("vec_id"), "label", "v", "copies")
    found = materialise(links(reps, threshold, trees), "vector-links")
    counts = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n_links").alias("others"))
    edges = found.select(F.col("vec_id").alias("a"), F.col("low").alias("b"))
    labels = components(edges).withColumnRenamed("node", "rep")
    told = members.join(counts, "rep", "left").join(labels, "rep", "left").select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    joined = vectors.select("vec_id").join(told, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
