"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct word shingles. A register is the smallest of exponentially distributed
hashes of the set's elements, truncated to an exponent of ``BASE``; registers of a union are the larger of
both, so sketches merge. Documents that agree in all registers of a band are candidates. A candidate pair's
similarity is estimated jointly, by the likelihood of how many registers are larger, smaller and equal given both
set sizes; pairs that may reach the threshold are confirmed on the full sets of their texts.

Documents with the same set are one class, whose smallest doc_id stands for it. In a bucket, classes are first
compared with one hub only, the class that shares most buckets. Links then join components, and only members of different
components are compared further: with the bucket's own hub, then all with all in buckets of up to ``MEMBERS``, as most
are, and with ``FEW`` members in larger ones. What these still need is found by an exact prefix filter, so no pair that links is
left out and the pairs do not grow with the square of a bucket.

Defined results: null, empty and white-space texts have no shingles and are linked with nothing; texts
with fewer words than a shingle have one, their whole sequence; repeated rows and a doc_id on several rows count as
one document linked by any of its texts, and return a row each; a null doc_id is linked with nothing, has no
component and is kept; an empty table gives no rows; other columns stay with ``near_duplicates``.
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
from barloom.llm.words import MIX, chunks, coded_words, mixed, word_hashes

BANDS, BAND = 24, 4
#: Base of the exponents and rate of the exponential distribution.
BASE, RATE = 1.02, 20.0
#: A pair is confirmed on its texts if its estimate is not below the threshold by more: six deviations.
MARGIN = 0.25
#: Members of a bucket that are all compared with each other, and of larger buckets, that the others are compared with
#: before the prefix filter, which compares the rest of those.
MEMBERS, FEW = 16, 4

FACTORS = np.random.default_rng(71).integers(1, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Values hashed at a time.
BLOCK = 1 << 16


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    for start, stop in chunks(texts):
        codes, starts, vocabulary = coded_words(texts[start:stop], lower=True)
        hashes = word_hashes(vocabulary)[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
        rolled = hashes
        for j in range(1, size):
            rolled = mixed(rolled[: len(hashes) - j] * MIX + hashes[j:]) if len(hashes) > j else rolled[:0]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                one = hashes[a : a + 1]
                for j in range(a + 1, b):
                    one = mixed(one * MIX + hashes[j : j + 1])
                out.append(mixed(one + MIX))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def registers(elements: np.ndarray) -> np.ndarray:
    """Truncated exponents of the smallest hashes of a set that is not empty."""
    low = np.empty(len(FACTORS), dtype=np.uint64)
    rows = max(1, BLOCK // len(elements))
    for i in range(0, len(FACTORS), rows):
        low[i : i + rows] = (elements[None, :] * FACTORS[i : i + rows, None]).min(axis=1)
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, 65535).astype(">u2")


def similarities(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches, on a grid of hundredths."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    total = (sizes_a + sizes_b).astype(float)
    u, v = sizes_a / total, sizes_b / total
    grid = np.arange(0, 100) / 100
    grid = np.minimum(grid[None, :], (np.minimum(u, v) / np.maximum(u, v))[:, None] - 1e-9)

    def share(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    more = np.clip(share(np.maximum(u[:, None] - v[:, None] * grid, 0)), 1e-12, 1)
    less = np.clip(share(np.maximum(v[:, None] - u[:, None] * grid, 0)), 1e-12, 1)
    same = np.clip(1 - more - less, 1e-12, 1)
    likely = larger[:, None] * np.log(more) + smaller[:, None] * np.log(less) + equal[:, None] * np.log(same)
    return np.take_along_axis(grid, likely.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketches(docs: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hash of the set), sketch (registers, two bytes each; null for an empty set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for start, stop in chunks(texts):
                out = []
                sets = shingle_sets(texts[start:stop], size)
                for doc_id, found in zip(frame["doc_id"][start:stop], sets):
                    if len(found):
                        h1, h2 = mixed(found).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(found + MIX))
                        out.append((doc_id, len(found), int(h1.view(np.int64)), int(h2.view(np.int64)), registers(found).tobytes()))
                    else:
                        out.append((doc_id, 0, None, None, None))
                names = ["doc_id", "n_shingles", "h1", "h2", "sketch"]
                yield pd.DataFrame(out, columns=names).astype({"h1": "Int64", "h2": "Int64"})

    chosen = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return chosen.mapInPandas(run, f"doc_id {kind}, n_shingles long, h1 long, h2 long, sketch binary")


def _likely(pairs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate is not clearly below the threshold."""
    of = sketched.select("rep", "n_shingles", "sketch")
    both = pairs.join(of.toDF("a", "size_a", "sketch_a"), "a").join(of.toDF("b", "size_b", "sketch_b"), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rows = [np.frombuffer(b"".join(frame[c]), dtype=">u2").reshape(len(frame), -1) for c in ("sketch_a", "sketch_b")]
                near = similarities(*rows, frame["size_a"].to_numpy(), frame["size_b"].to_numpy())
                yield frame.loc[near >= threshold - MARGIN, ["a", "b"]]

    return both.mapInPandas(run, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    kind = pairs.schema["a"].dataType.simpleString()
    percent = round(threshold * 100)
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start, stop in chunks(frame["text_b"].tolist()):
                part = frame.iloc[start:stop]
                hubs = part["text_a"].tolist()
                new = [not i or hubs[i] != hubs[i - 1] for i in range(len(hubs))]
                firsts = iter(shingle_sets([hub for hub, first in zip(hubs, new) if first], size))
                one, found = None, []
                for first, other in zip(new, shingle_sets(part["text_b"].tolist(), size)):
                    one = next(firsts) if first else one
                    shared = len(np.intersect1d(one, other, assume_unique=True))
                    found.append(100 * shared >= percent * (len(one) + len(other) - shared))
                yield part.loc[found, ["a", "b"]]

    return both.mapInPandas(run, f"a {kind}, b {kind}")


def links(docs: DataFrame, sketched: DataFrame, size: int, threshold: float) -> DataFrame:
    """Edges (a, b) that connect all documents linked directly or through others."""
    filled = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    copies = filled.join(classes, ["h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    # A doc_id on several rows can stand for several classes; its node is one.
    reps = filled.join(classes.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "doc_id"])
    reps = materialise(
        reps.select(F.col("doc_id").alias("rep"), "h1", "h2", "n_shingles", "sketch").dropDuplicates(["h1", "h2"]), "reps"
    )
    pieces = F.array(*[F.substring("sketch", 2 * BAND * i + 1, 2 * BAND) for i in range(BANDS)])
    rows = reps.select("rep", "n_shingles", F.posexplode(pieces).alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialise(rows.join(shared, ["band", "key"]), "bands")
    # The member that shares most buckets with most others is likeliest to be near all of them.
    rank = F.struct("shared", (-F.col("rep")).alias("rep"))
    ranked = rows.join(rows.groupBy("rep").agg(F.sum("n").alias("shared")), "rep").withColumn("rank", rank)
    hubs_of = ranked.groupBy("band", "key").agg(F.max("rank").alias("top"))
    members = materialise(
        ranked.drop("rank", "shared", "n").join(hubs_of, ["band", "key"]).withColumn("hub", -F.col("top.rep")), "buckets"
    )
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def decide(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = materialise(pairs.distinct(), "pairs")
        likely = materialise(_likely(pairs, reps, threshold), "likely")
        return pairs, materialise(_confirmed(likely.distinct(), texts, size, threshold).distinct(), "links")

    leading = members.where("hub <> rep").groupBy("rep").agg(F.max("top").alias("top")).select("rep", (-F.col("top.rep")).alias("hub"))
    done, edges = decide(leading.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")))

    def placed() -> tuple[DataFrame, DataFrame]:
        """Members with their components so far, and the buckets that hold several components."""
        whose = members.select("rep").distinct().join(components(edges).withColumnRenamed("node", "rep"), "rep", "left")
        whose = materialise(whose.select("rep", F.coalesce("component", "rep").alias("component")), "components")
        now = members.join(whose, "rep")
        several = now.groupBy("band", "key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")
        )
        return now, several.where("low < high").select("band", "key", "n")

    for others in ("hub = rep", None):
        now, several = placed()
        open_ = now.join(several, ["band", "key"])
        # All of a bucket of up to MEMBERS, about FEW of a larger one, chosen by hash: what does not link with the hubs
        # seldom links with others, so more of them are mostly pairs in vain, as many times a group's size.
        chance = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chosen = open_.where(others) if others else open_.where((F.col("n") <= MEMBERS) | (chance * F.col("n") < FEW))
        one = chosen.select("band", "key", F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("n_shingles").alias("nx"))
        other = open_.select("band", "key", F.col("rep").alias("y"), F.col("component").alias("cy"), F.col("n_shingles").alias("ny"))
        # Sets whose sizes differ by more than the threshold allows cannot reach it.
        possible = (F.col("cx") != F.col("cy")) & (100 * F.least("nx", "ny") >= round(threshold * 100) * F.greatest("nx", "ny"))
        pairs = one.join(other, ["band", "key"]).where(possible).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        # A pair that shares several buckets is one pair.
        tried, found = decide(pairs.distinct().join(done, ["a", "b"], "left_anti"))
        done, edges = done.union(tried), edges.union(found)
    now, several = placed()
    crowded = now.join(several.where(F.col("n") > MEMBERS), ["band", "key"], "left_semi").select("rep", "component").distinct()
    _, found = decide(_rest(crowded, texts, size, threshold).distinct().join(done, ["a", "b"], "left_anti"))
    return copies.union(edges).union(found)


def _rest(crowded: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """All pairs (a, b) of different components that can reach the threshold, among (rep, component).

    An exact prefix filter: with the elements of all sets in one order, rare ones first, two sets that share t elements
    share one among the first n - t + 1 of each. Per element, members of the component that most members have need
    not meet each other.
    """
    percent = round(threshold * 100)
    kind = crowded.schema["rep"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            all_texts = frame["text"].tolist()
            for start, stop in chunks(all_texts):
                sets = shingle_sets(all_texts[start:stop], size)
                lengths = [len(x) for x in sets]
                part = frame.iloc[np.repeat(np.arange(start, stop), lengths)][["rep", "component", "copy"]]
                elements = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                yield part.assign(n=np.repeat(lengths, lengths).astype(np.int64), element=elements.view(np.int64))

    held = texts.withColumnRenamed("doc_id", "rep").join(crowded, "rep").withColumn("copy", F.xxhash64("text"))
    held = held.select("rep", "component", "copy", "text").mapInPandas(
        run, f"rep {kind}, component {kind}, copy long, n long, element long"
    )
    held = materialise(held, "elements")
    counts = held.groupBy("element").agg(F.count(F.lit(1)).alias("docs"))
    ordered = held.join(counts, "element").groupBy("rep", "component", "copy", "n").agg(
        F.sort_array(F.collect_list(F.struct("docs", "element"))).alias("elements")
    )
    longest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = ordered.select("rep", "component", "n", F.posexplode(F.slice("elements", F.lit(1), longest.cast("int"))).alias("at", "e"))
    first = first.where("e.docs > 1").select("rep", "component", "n", "at", "e.element")
    by_component = first.groupBy("element", "component").agg(F.count(F.lit(1)).alias("rows"))
    most = by_component.groupBy("element").agg(
        F.max(F.struct("rows", "component")).alias("most"), F.count(F.lit(1)).alias("components")
    )
    first = materialise(first.join(most.where("components > 1").select("element", F.col("most.component").alias("main")), "element"), "prefixes")
    few, every = first.where("component <> main"), first
    few = few.select("element", *(F.col(c).alias(f"{c}_x") for c in ("rep", "component", "n", "at")))
    total = percent * (F.col("n_x") + F.col("n"))
    shared = F.ceil(total / (100 + percent))
    meets = (F.col("component_x") != F.col("component")) & (F.col("at_x") <= F.col("n_x") - shared) & (F.col("at") <= F.col("n") - shared)
    pairs = few.join(every, "element").where(meets)
    return pairs.select(F.least("rep", "rep_x").alias("a"), F.greatest("rep", "rep_x").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; texts are compared by shingles of ``size`` words."""
    sketched = materialise(sketches(docs, size), "sketches")
    found = components(links(docs, sketched, size, threshold)).withColumnRenamed("node", "doc_id")
    joined = sketched.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, whose document is kept."""
    gone = near_duplicates(docs, size, threshold).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
