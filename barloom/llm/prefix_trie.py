"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns. Its identity is 128 bits: the exclusive or of two 64-bit hashes of every
turn with its place, so a running aggregate gives all prefixes of a conversation, and nodes with their members are one grouping.
Totals of subtrees then travel upwards in time-forward processing: nodes are sorted by reverse level order, every
node takes the messages that its children have left for it in a priority queue, and leaves one for its parent. The queue keeps
a bounded number of messages in memory and spills sorted runs to disk.

A shard is a set of whole subtrees whose tops have at most ``bound`` members while their parents have more. Their totals are
added by parent, and the nodes above, of which there are at most rows / ``bound``, are processed the same way. The bound
is a hundred-thousandth of all turns (1,000 at least), so both a subtree and the part above stay small beside the table; it decides only where work is
done. A very common turn is a node above; a conversation that many share is a few nodes. Conversations are read
in blocks of ``BLOCK`` turns with carried places and hashes, so that a very long one is no single group. The ids that
end at a node are joined in sorted runs over all tasks, and only the runs' strings are put through SHA-256 one after the other.

Defined results: a null turn comes first; equal turn numbers stand by role, then text; null roles and texts are empty; repeated rows
are repeated turns; rows without conv_id belong to no conversation; an empty table has no nodes, not even the root; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.shared import materialise

#: First turns that a conversation may take from another, and how many ids share a giver.
HEADS, SHARING = 6, 100
#: Turns of a conversation that are put in order in one group.
BLOCK = 1024
LEAST_BOUND, ABOVE = 1000, 100_000
#: Messages in memory before a run is spilled.
MESSAGES = 200_000
#: Characters of a run of ids.
RUN_CHARS = 1 << 16

NODE = ["depth", "p1", "p2"]
TOTALS = "depth int, p1 long, p2 long, n_children long, n_leaves long, saved_tokens long"


class SpillingQueue:
    """Messages (depth, p1, p2, leaves, saved), deepest first; beyond ``limit`` in memory they go to disk in sorted runs."""

    RECORD = struct.Struct("<5q")

    def __init__(self, limit: int = MESSAGES):
        self.limit, self.near, self.runs, self.spilled = limit, [], [], 0

    def push(self, depth: int, p1: int, p2: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.near, (-depth, p1, p2, leaves, saved))
        if len(self.near) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for message in sorted(self.near):
            file.write(self.RECORD.pack(*message))
        file.seek(0)
        self.near = []
        self.spilled += 1
        self._next(file)

    def _next(self, file) -> None:
        """Put the run's first message that is left among the heads of runs."""
        record = file.read(self.RECORD.size)
        if record:
            # Files cannot be compared; the number of the file settles ties.
            heapq.heappush(self.runs, (self.RECORD.unpack(record), file.fileno(), file))
        else:
            file.close()

    def take(self, depth: int, p1: int, p2: int) -> Iterator[tuple[int, int]]:
        """leaves and saved of all messages to a node; its children must have come before."""
        key = (-depth, p1, p2)
        while self.near and self.near[0][:3] == key:
            yield heapq.heappop(self.near)[3:]
        while self.runs and self.runs[0][0][:3] == key:
            message, _, file = heapq.heappop(self.runs)
            self._next(file)
            yield message[3:]


def digits(c: str) -> Column:
    return F.col(c).cast("long").cast("string").cast("binary")


def in_blocks(rows: DataFrame, block: Column, order: list[Column], carried: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Running values of a conversation, block by block: name -> (value within the block, aggregate of a whole block).

    Blocks of one conversation are summed up first; each row then adds what the blocks before it hold.
    """
    rows = rows.withColumn("_block", block)
    inner = Window.partitionBy("conv_id", "_block").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "_block").agg(*[whole.alias(f"_{c}") for c, (_, whole) in carried.items()])
    sums = sums.select("conv_id", "_block", *[_carry(c, before).alias(f"_{c}") for c in carried])
    out = rows.withColumns({c: within.over(inner) for c, (within, _) in carried.items()}).join(sums, ["conv_id", "_block"])
    return out.withColumns({c: _joined(c) for c in carried}).drop("_block", *[f"_{c}" for c in carried])


def _carry(c: str, before) -> Column:
    total = F.sum(f"_{c}") if c == "place" else F.bit_xor(f"_{c}")
    return F.coalesce(total.over(before), F.lit(0).cast("long"))


def _joined(c: str) -> Column:
    return F.col(c) + F.col(f"_{c}") if c == "place" else F.col(c).bitwiseXOR(F.col(f"_{c}"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), c1, c2 (hashes of role and text), chars."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    block = F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(2**62)))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    placed = in_blocks(turns, block, order, {"place": (F.row_number(), F.count(F.lit(1)))})
    hashes = [F.xxhash64(F.lit(lane), "role", "text").alias(f"c{lane}") for lane in (1, 2)]
    return placed.select("conv_id", "place", *hashes, F.char_length("text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their giver: (conv_id, depth, c1, c2, chars), and (conv_id, length) of all."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % SHARING).alias("giver"), (F.crc32(digits("conv_id")) % HEADS).alias("h"))
    firsts = turns.where((F.col("conv_id") % SHARING == 0) & (F.col("place") < HEADS))
    # At most five turns of a giver, for the hundred ids that share it.
    given = firsts.groupBy(F.col("conv_id").alias("giver")).agg(F.sort_array(F.collect_list(F.struct("place", "c1", "c2", "chars"))).alias("head"))
    convs = convs.join(given, "giver", "left").withColumn("head", F.slice("head", F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("taken", F.coalesce(F.array_size("head"), F.lit(0)).cast("long"))
    heads = convs.select("conv_id", F.explode("head").alias("t"))
    heads = heads.select("conv_id", F.col("t.place").alias("depth"), *[F.col(f"t.{c}").alias(c) for c in ("c1", "c2", "chars")])
    shifts = convs.select("conv_id", "h", "taken")
    tails = turns.join(shifts, "conv_id").where(F.col("place") > F.col("h"))
    tails = tails.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "c1", "c2", "chars")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("length"))
    return heads.unionByName(tails), lengths


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (the prefix that ends here), q1, q2 (the one before it), chars."""
    rows = rows.withColumns({f"e{lane}": F.xxhash64(F.lit(lane), "depth", f"c{lane}", f"c{3 - lane}") for lane in (1, 2)})
    block = F.floor((F.col("depth") - 1) / BLOCK)
    xor = {f"p{lane}": (F.bit_xor(f"e{lane}"), F.bit_xor(f"e{lane}")) for lane in (1, 2)}
    rows = in_blocks(rows, block, [F.asc("depth")], xor)
    before = {f"q{lane}": F.col(f"p{lane}").bitwiseXOR(F.col(f"e{lane}")) for lane in (1, 2)}
    return rows.withColumns(before).select("conv_id", F.col("depth").cast("int").alias("depth"), "p1", "p2", "q1", "q2", "chars")


def passed_up(nodes: DataFrame, messages: int = MESSAGES) -> DataFrame:
    """TOTALS of nodes (depth, p1, p2, q1, q2, top, weight, children, leaves, saved), sorted deepest first in each task.

    children, leaves and saved are what comes from below other nodes of the task; a top leaves no message.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(messages)
        for batch in batches:
            out = []
            for depth, p1, p2, q1, q2, top, weight, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
                for more_leaves, more_saved in queue.take(depth, p1, p2):
                    children += 1
                    leaves += more_leaves
                    saved += more_saved
                leaves, saved = leaves or 1, saved + weight
                out.append((depth, p1, p2, children, leaves, saved))
                if not top:
                    queue.push(depth - 1, q1, q2, leaves, saved)
            columns = list(zip(*out))
            kinds = [pa.int32()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], [*NODE, "n_children", "n_leaves", "saved_tokens"]
            )

    columns = ["depth", "p1", "p2", "q1", "q2", "top", "weight", "children", "leaves", "saved"]
    return nodes.sortWithinPartitions(F.desc("depth"), "p1", "p2").select(*columns).mapInArrow(run, TOTALS)


def end_hashes(ends: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256 of (depth, p1, p2, conv_id): decimal ids in order, joined by commas."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, None, [], 0

        def done() -> pa.RecordBatch:
            row = {"depth": pa.array([node[0]], pa.int32()), "p1": [node[1]], "p2": [node[2]], "first": [first], "ids": [",".join(held)]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for *key, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node or size > RUN_CHARS:
                    if held:
                        yield done()
                    node, first, held, size = key, conv_id, [], 0
                held.append(str(conv_id))
                size += len(held[-1]) + 1
        if held:
            yield done()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def done() -> pa.RecordBatch:
            row = {"depth": pa.array([node[0]], pa.int32()), "p1": [node[1]], "p2": [node[2]], "ends_sha256": [state.hexdigest()]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if node is not None:
                        yield done()
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node is not None:
            yield done()

    # Ranges of (node, id) spread a node with very many ids over tasks; their runs come together as few long rows.
    spread = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = spread.mapInArrow(runs, "depth int, p1 long, p2 long, first long, ids string")
    together = joined.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return together.mapInArrow(hashed, "depth int, p1 long, p2 long, ends_sha256 string")


def trie(conversations: DataFrame, bound: int | None = None, messages: int = MESSAGES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    turns = materialise(ordered_turns(conversations), "turns")
    rows, lengths = rebuilt(turns)
    rows = materialise(prefixes(rows), "prefixes")
    lengths = materialise(lengths, "lengths")
    if bound is None:
        bound = max(LEAST_BOUND, rows.count() // ABOVE)
    zero = F.lit(0).cast("long")

    members = rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    )
    root = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(0).alias("depth"), zero.alias("p1"), zero.alias("p2"), "n_convs", "conv_id", zero.alias("chars"), zero.alias("q1"), zero.alias("q2"))
    nodes = materialise(members.unionByName(root), "nodes")
    weight = ((F.col("n_convs") - 1) * F.col("chars")).alias("weight")
    high = nodes.where((F.col("n_convs") > bound) | (F.col("depth") == 0))

    # The top of a node's shard: each conversation leaves the high nodes at one depth, and its node there is the top.
    known = F.broadcast(high.where("depth > 0").select(*NODE, F.lit(True).alias("high")))
    low = rows.select("conv_id", *NODE).join(known, NODE, "left").where("high IS NULL").drop("high")
    tops = low.groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("top"))
    owned = nodes.join(F.broadcast(high.select(*NODE)), NODE, "left_anti").join(tops, "conv_id")
    top = (F.col("top.depth") == F.col("depth")).alias("top_here")
    owned = owned.select(*NODE, "q1", "q2", weight, top, F.col("top.p1").alias("s1"), F.col("top.p2").alias("s2"))
    owned = owned.repartition("s1", "s2").withColumnRenamed("top_here", "top")
    below = materialise(
        passed_up(owned.withColumns({"children": zero, "leaves": zero, "saved": zero}), messages), "below"
    )

    # What leaves the shards, added by parent, for the few nodes above.
    child = [(F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2")]
    parent = ["depth", "q1", "q2"]
    high_parents = F.broadcast(high.select(*child))
    leaving = nodes.join(high_parents, parent, "left_semi").select(*NODE, "q1", "q2").join(below, NODE)
    sent = leaving.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    upper = high.select(*NODE, "q1", "q2", (F.col("depth") == 0).alias("top"), weight).join(sent, NODE, "left")
    above = passed_up(upper.fillna(0, ["children", "leaves", "saved"]).repartition(1), messages)

    totals = below.unionByName(above)
    last = lengths.where("length > 0").select("conv_id", F.col("length").alias("end"))
    ends = rows.select("conv_id", *NODE).join(last, "conv_id").where("depth = end")
    turnless = lengths.where("length = 0").select("conv_id", F.lit(0).alias("depth"), zero.alias("p1"), zero.alias("p2"))
    ends = end_hashes(ends.select("conv_id", *NODE).unionByName(turnless))
    # A parent with many children is a node above; those are few and come by broadcast.
    name = F.col("conv_id").alias("parent_conv_id")
    under_high = nodes.join(F.broadcast(high.select(*child, name)), parent)
    low_parents = nodes.join(F.broadcast(high.select(*NODE)), NODE, "left_anti").select(*child, name)
    under_low = nodes.join(high_parents, parent, "left_anti").join(low_parents, parent, "left")
    out = under_high.unionByName(under_low).join(totals, NODE).join(ends, NODE, "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
