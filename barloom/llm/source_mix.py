"""Mixing sources to target weights, by blocks.

The words of a source are one stream, packed into blocks of ``BLOCK`` words. The mix has as many slots as the
targets make blocks, dealt into shards. In every shard the sources' counts are drawn as a stratified multinomial: each
slot draws one number in its own stratum of the unit interval, and the sources divide the interval by their
targets; counts vary by a slot or two per shard instead of by their square root. The slots of a source are numbered through all
shards, a permutation of the source's blocks maps the numbers to blocks, anew for each round through the source, and slots
and blocks meet in a join on the block's index. A block is taken at most ``ROUNDS`` times.

All of it is DataFrame operations. A source's stream is numbered in chunks of documents, so a source with a third
of all rows is not one window; the same holds for blocks and slots.

Defined results: a null text has size 0; null sources are one source, the last; sources without words have target
and taken 0; repeated rows are rows of their own; a null doc_id is an ordinary one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.shared import materialise

BLOCK = 32
SLOTS = 65_536
ROUNDS = 3
WEIGHTS = (5, 2, 1)
#: Documents of a chunk, about.
CHUNK = 5_000
#: Cells of the unit interval by which numbers find their source.
CELLS = 1024
#: Multipliers of the permutations: primes, so that they permute every length they do not divide.
PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039)
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy (hash of the text) and size, the number of its words, of every row."""
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), "\t\n\x0b\f\r", "     ")
    words = F.size(F.filter(F.split(plain, " "), lambda word: word != ""))
    return docs.select("doc_id", "source", F.xxhash64("text").alias("copy"), words.cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, sid, source_size, target of each source of (source, size).

    Shares by weight level up like water in vessels of different height: sources are capped in the order of cap by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    table = by_source.withColumn("sid", rank).withColumn("weight", weights[(F.col("sid") % len(WEIGHTS)).cast("int")])
    table = table.withColumn("cap", ROUNDS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    table = table.withColumn("level", left / F.sum("weight").over(onward))
    # The first level that its own source's cap holds is the level of all that follow.
    table = table.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ))
    first = F.first("final", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(first.isNull(), F.col("cap").cast("double")).otherwise(first * F.col("weight"))
    return table.withColumn("target", target).select("source", "sid", "source_size", "target")


def streamed(docs: DataFrame, table: DataFrame, chunks: int) -> DataFrame:
    """Rows of sized() with sid, source_size, target and begin: where the document starts in its source's stream."""
    same = F.col("source").eqNullSafe(F.col("t_source"))
    joined = docs.join(table.withColumnRenamed("source", "t_source"), same).drop("t_source")
    joined = joined.withColumn("chunk", F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(chunks)))
    inside = Window.partitionBy("sid", "chunk").orderBy("doc_id", "size", "copy")
    joined = joined.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = joined.groupBy("sid", "chunk").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "chunk", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    return joined.join(totals, ["sid", "chunk"]).withColumn("begin", F.col("ahead") + F.col("inside")).drop("chunk", "ahead", "inside")


def drawn(table: DataFrame) -> DataFrame:
    """shard, sid, first, n: the sources' slot counts of each shard, and their first slot's place."""
    spark = table.sparkSession
    total = table.agg(F.sum("target")).first()[0] or 0.0
    slots = round(total / BLOCK + 0.5) if total else 0
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    ends = table.where("target > 0").withColumn("high", F.sum("target").over(order) / F.lit(total or 1.0))
    low = F.lag("high", 1, 0.0).over(Window.orderBy("sid"))
    last = F.lead("high").over(Window.orderBy("sid")).isNull()
    ends = ends.select("sid", low.alias("low"), F.when(last, F.lit(2.0)).otherwise(F.col("high")).alias("high"))
    low_cell, high_cell = (F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1)) for c in ("low", "high"))
    cells = materialise(ends.withColumn("cell", F.explode(F.sequence(low_cell, high_cell))), "mix-cells")
    each = spark.range(slots).select(
        F.floor(F.col("id") / SLOTS).alias("shard"),
        (F.col("id") % SLOTS).alias("i"),
        F.least(F.lit(SLOTS), F.lit(slots) - F.floor(F.col("id") / SLOTS) * SLOTS).alias("width"),
    )
    jitter = ((F.col("i") * 7919 + F.col("shard") * 104729 + 13) % 10007) / F.lit(10007.0)
    each = each.withColumn("u", (F.col("i") + jitter) / F.col("width"))
    each = each.withColumn("cell", F.floor(F.col("u") * CELLS))
    found = each.join(cells, "cell").where("u >= low and u < high")
    return found.groupBy("shard", "sid").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))


def permuted(number, blocks, turn):
    """The block of a slot number: an affine permutation of the source's blocks, with other constants each round."""
    factors = [F.when(blocks % a != 0, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(PRIMES, PRIMES[1:])]
    factor = F.when(turn == 0, factors[0]).when(turn == 1, factors[1]).otherwise(factors[2])
    return ((number % blocks) * factor + turn * 7_368_787 + 104_651) % blocks


def slots(counts: DataFrame, table: DataFrame) -> DataFrame:
    """shard, slot, sid, block: what each slot of the mix takes."""
    ahead = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    blocks = table.select("sid", F.ceil(F.col("source_size") / BLOCK).alias("blocks"))
    each = counts.join(blocks, "sid").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    number = F.col("ahead") + F.col("j")
    each = each.withColumn("number", number).where(F.col("number") < ROUNDS * F.col("blocks"))
    turn = F.floor(F.col("number") / F.col("blocks"))
    return each.select("shard", (F.col("first") + F.col("j")).alias("slot"), "sid", permuted(F.col("number"), F.col("blocks"), turn).alias("block"))


def pieces(streams: DataFrame) -> DataFrame:
    """sid, block, begin, start, length: the words that each document has in each block of its source."""
    first, last = F.floor(F.col("begin") / BLOCK), F.floor((F.col("begin") + F.col("size") - 1) / BLOCK)
    each = streams.where("size > 0").select("sid", "begin", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("block") * BLOCK, F.col("begin"))
    stop = F.least((F.col("block") + 1) * BLOCK, F.col("begin") + F.col("size"))
    return each.select("sid", "block", "begin", (start - F.col("begin")).alias("start"), (stop - start).alias("length"))


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The streams, and per piece that is taken how often. Words are counted once; all else works on narrow rows."""
    narrow = materialise(sized(docs), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    table = materialise(targets(sizes), "mix-sources")
    chunks = max(1, -(-narrow.count() // CHUNK))
    streams = materialise(streamed(narrow, table, chunks), "mix-streams")
    taken = slots(materialise(drawn(table), "mix-counts"), table).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    return streams, pieces(streams).join(taken, ["sid", "block"])


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    streams, parts = _prepared(docs)
    words = parts.groupBy("sid", "begin").agg(F.sum(F.col("times") * F.col("length")).alias("words"))
    # Documents without words share their begin with others.
    filled = F.when(F.col("size") > 0, F.col("begin"))
    joined = streams.withColumn("begin", filled).join(words, ["sid", "begin"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mix_texts(docs: DataFrame) -> DataFrame:
    """The mix as rows of docs: for each round, every document that gives words to it, with those words as its text.

    The words of a row keep their order, joined by one space; n_chars, where there is one, is counted anew. Rows equal
    in doc_id, source and text each give words, with the other columns of one of them.
    """
    columns = docs.columns
    streams, parts = _prepared(docs)
    parts = parts.groupBy("sid", "begin").agg(F.sort_array(F.collect_list(F.struct("start", "length", "times"))).alias("parts"))
    chosen = streams.where("size > 0").join(parts, ["sid", "begin"]).select(
        F.col("doc_id").alias("id"), F.col("source").alias("from"), "copy", "parts"
    )
    others = F.struct(*[F.col(c) for c in columns if c != "text"])
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("from"), F.xxhash64("text").alias("copy"), others.alias("row"), "text")
    rows = rows.groupBy("id", "from", "copy").agg(F.first("row").alias("row"), F.first("text").alias("text"))
    same = [rows[c].eqNullSafe(chosen[c]) for c in ("id", "from", "copy")]
    joined = rows.join(chosen, same).select("row", "text", "parts")
    most = F.array_max(F.transform("parts", lambda p: p["times"]))
    plain = F.translate("text", "\t\n\x0b\f\r", "     ")
    joined = joined.withColumn("words", F.filter(F.split(plain, " "), lambda word: word != ""))
    joined = joined.withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    cut = F.transform(
        F.filter("parts", lambda p: p["times"] >= F.col("round")),
        lambda p: F.slice(F.col("words"), (p["start"] + 1).cast("int"), p["length"].cast("int")),
    )
    joined = joined.withColumn("text", F.array_join(F.flatten(cut), " "))
    out = {c: F.col("row")[c] for c in columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out[c].alias(c) for c in columns])


#: The same by plain SQL.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CASE sid % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight, {ROUNDS} * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
   / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
lvl AS (SELECT min(level) FILTER (level * weight <= cap) AS level, arg_min(cap / weight, cap / weight) FILTER (level * weight <= cap) AS start FROM s2),
s3 AS (SELECT sid, source, source_size, CASE WHEN cap / weight >= (SELECT start FROM lvl) THEN (SELECT arg_min(level, cap / weight) FROM s2 WHERE level * weight <= cap) * weight ELSE cap::DOUBLE END AS target FROM s2),
n AS (SELECT sum(target) AS total, round(sum(target) / {BLOCK} + 0.5)::BIGINT AS slots, greatest(1, ceil((SELECT count(*) FROM d) / {CHUNK}.0))::BIGINT AS chunks FROM s3),
e0 AS (SELECT sid, sum(target) OVER (ORDER BY sid) / (SELECT total FROM n) AS high FROM s3 WHERE target > 0),
e AS (SELECT sid, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low, CASE WHEN lead(high) OVER (ORDER BY sid) IS NULL THEN 2.0 ELSE high END AS high FROM e0),
r AS (SELECT id // {SLOTS} AS shard, id % {SLOTS} AS i, least({SLOTS}, (SELECT slots FROM n) - id // {SLOTS} * {SLOTS}) AS width
   FROM (SELECT unnest(range((SELECT slots FROM n))) AS id)),
u AS (SELECT shard, i, (i + ((i * 7919 + shard * 104729 + 13) % 10007) / 10007.0::DOUBLE) / width AS u FROM r),
c AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY shard, i) - 1 AS number FROM u JOIN e ON u.u >= e.low AND u.u < e.high),
k AS (SELECT c.sid, number, ceil(source_size / {BLOCK}.0)::BIGINT AS blocks FROM c JOIN s3 USING (sid)),
k2 AS (SELECT sid, blocks, number % blocks AS p, number // blocks AS turn FROM k WHERE number < {ROUNDS} * blocks),
t AS (SELECT sid, (p * CASE turn WHEN 0 THEN CASE WHEN blocks % {PRIMES[0]} <> 0 THEN {PRIMES[0]} ELSE {PRIMES[1]} END
   WHEN 1 THEN CASE WHEN blocks % {PRIMES[1]} <> 0 THEN {PRIMES[1]} ELSE {PRIMES[2]} END
   ELSE CASE WHEN blocks % {PRIMES[2]} <> 0 THEN {PRIMES[2]} ELSE {PRIMES[3]} END END + turn * 7368787 + 104651) % blocks AS block, count(*) AS times
   FROM k2 GROUP BY 1, 2),
w AS (SELECT doc_id, size, s3.sid, source_size, target, sum(size) OVER (PARTITION BY s3.sid
   ORDER BY coalesce(doc_id, 0) % (SELECT chunks FROM n), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS b
   FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
p AS (SELECT w.sid, b, unnest(range((b // {BLOCK})::BIGINT, ((b + size - 1) // {BLOCK})::BIGINT + 1)) AS block, size FROM w WHERE size > 0),
x AS (SELECT p.sid, b, sum(times * (least((p.block + 1) * {BLOCK}, b + size) - greatest(p.block * {BLOCK}, b))) AS words FROM p JOIN t ON p.sid = t.sid AND p.block = t.block GROUP BY 1, 2)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(words, 0) ELSE 0 END::BIGINT AS taken
FROM w LEFT JOIN x ON w.sid = x.sid AND w.b = x.b AND size > 0
"""
