"""Phrase collocations by stripes.

Every word of a text starts one window of up to five words within its piece. A window is an entry of one stripe: its
words but the last are the prefix, the last one is a next word with its count. Tasks build stripes of what they read,
stripes of one prefix are merged elementwise, and from the merged ones everything follows: entries are the counts of phrases,
the total of a prefix's stripe is the count of the prefix itself, and it goes as an entry into the stripe one word shorter. So
stripes of four-word prefixes are merged first, and the stripe of the empty prefix, whose entries are the words
and whose total is the number of all words, comes last. The largest entries are what a phrase's longer phrases have.

A stripe is dealt into parts by its next words, one for every ``PART`` times that its prefix can stand in the corpus at most, so
a part stays small however hot the prefix; the bound is the count of the prefix's rarest word, or of words with its hash. The stripes
of a task that belong to one shard (a hash of prefix and part) travel as one row; there is a shard for every ``SHARD`` words
of the corpus, which bounds what is merged at a time. Windows end early where their words stand
together too rarely for a phrase: pairs, and then the longer runs of pairs left, are counted in ``2 ** bits`` buckets over all texts
first, and a run may be frequent if its bucket is. The buckets' bits (8 MB each time at 26 bits) are broadcast; their number does
not grow with the data. Where many runs share buckets, fewer windows end early, which costs more shuffled bytes but no result.

Defined results: a null lang counts as ``und``; null and empty texts have no words; repeated rows count as often as they come;
an empty table gives no rows; other columns of the input, doc_id too, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.shared import materialise
from barloom.llm.words import MIX, chunks, mixed, word_hashes

LONGEST = 5
BITS, BLOCK = 26, 1 << 16
#: Buckets that words are counted in, and occurrences of a prefix per part of its stripe.
WORD_BITS, PART, MOST_PARTS = 20, 1 << 16, 1 << 12
#: Words of the corpus per shard, and the least number of shards.
SHARD, SHARDS = 1 << 22, 64
#: Entries whose prefixes and words are Python strings at a time, and rows that a task adds up together.
ENTRIES, ROWS = 1 << 16, 500_000
#: Copies of the counts that cut phrases are looked up in, so that a common first word is no hot key.
SALTS = 8
SEPARATORS = r"[.,;:!?\n\x0B\f\r]+"

STRIPES = "lang string, level int, shard int, prefix array<string>, next array<string>, n array<long>"
MERGED = "lang string, level int, shard int, prefix string, total long, next array<string>, n array<long>, up_prefix string, up_next string, up_shard int"


def coded_pieces(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Codes of all words in order, -1 between pieces, and the vocabulary."""
    column = pa.array(texts, pa.large_string())
    apart = pc.replace_substring_regex(pc.ascii_lower(column), SEPARATORS, " . ")
    words = pc.ascii_split_whitespace(pc.binary_join_element_wise(apart, pa.scalar(" .", column.type), pa.scalar("", column.type))).values
    coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    between = pc.index(coded.dictionary, ".").as_py()
    if between >= 0:
        codes[codes == between] = -1
    return codes, coded.dictionary


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """Per language (column 0) and run of texts (column 1): language, codes, vocabulary."""
    for lang in batch.column(0).unique().to_pylist():
        texts = batch.column(1).filter(pc.equal(batch.column(0), lang)).to_pylist()
        for start, stop in chunks(texts):
            yield lang, *coded_pieces(texts[start:stop])


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, and at the end, what Arrow holds for reuse goes back to the system: workers outlive their tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


class Runs:
    """Hashes of the runs of words that start at each place, and whether they may be frequent."""

    def __init__(self, lang: str, codes: np.ndarray, vocabulary: pa.Array, bits: int):
        self.bits, self.words = bits, np.zeros(len(codes) + LONGEST, dtype=np.uint64)
        self.inside = np.zeros(len(codes) + LONGEST, dtype=bool)
        self.inside[: len(codes)] = codes >= 0
        hashes = word_hashes(vocabulary.to_pylist(), xxhash.xxh3_64_intdigest(lang.encode()))
        self.words[: len(codes)][codes >= 0] = hashes[codes[codes >= 0]]
        self.runs, self.length = self.words.copy(), 1

    def longer(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of one more word starts, of those in ``at`` with a next word, and the runs' buckets."""
        places = np.flatnonzero(at & np.roll(self.inside, -self.length))
        self.runs[places] = mixed(self.runs[places] * MIX + self.words[places + self.length])
        self.length += 1
        return places, (self.runs[places] >> np.uint64(64 - self.bits)).astype(np.int64)

    def marked(self, places: np.ndarray, buckets: np.ndarray, filled: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words), dtype=bool)
        out[places] = (filled[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8)) & 1
        return out


def next_to(marks: np.ndarray) -> np.ndarray:
    """Places whose run is marked and the one that starts a word later too."""
    return marks & np.roll(marks, -1)


def counted_buckets(lang: str, codes: np.ndarray, vocabulary: pa.Array, bits: int, pairs: np.ndarray | None) -> np.ndarray:
    """Buckets of all pairs; given the pairs' bits, of the longer runs whose pairs may all be frequent."""
    runs = Runs(lang, codes, vocabulary, bits)
    places, buckets = runs.longer(runs.inside)
    if pairs is None:
        return buckets
    linked = runs.marked(places, buckets, pairs)
    at, out = linked, []
    for k in range(1, LONGEST - 1):
        at = at & np.roll(linked, -k)
        out.append(runs.longer(at)[1])
    return np.concatenate(out)


def extensions(lang: str, codes: np.ndarray, vocabulary: pa.Array, bits: int, pairs: np.ndarray, longer: np.ndarray) -> list[np.ndarray]:
    """Per number of words, from one on: where a window may have one more."""
    runs = Runs(lang, codes, vocabulary, bits)
    out = [runs.marked(*runs.longer(runs.inside), pairs)]
    while len(out) < LONGEST - 1:
        out.append(runs.marked(*runs.longer(next_to(out[-1])), longer))
    return out


class Parts:
    """How stripes are dealt, from the counts of words by bucket."""

    def __init__(self, words: np.ndarray):
        self.words, self.total = words, int(words.sum())
        self.shards = max(SHARDS, 1 << (self.total // SHARD).bit_length())

    def of(self, lang: str, prefixes: list[str]) -> np.ndarray:
        seed, known, out = xxhash.xxh3_64_intdigest(lang.encode()), {}, np.ones(len(prefixes), dtype=np.int64)
        for i, prefix in enumerate(prefixes):
            count = self.total
            for word in prefix.split(" ") if prefix else ():
                if word not in known:
                    known[word] = int(self.words[xxhash.xxh3_64_intdigest(word.encode(), seed) >> (64 - WORD_BITS)])
                count = min(count, known[word])
            out[i] = min(MOST_PARTS, 1 << (count // PART).bit_length())
        return out

    def shard(self, lang: str, prefixes: pa.Array, nexts: pa.Array) -> np.ndarray:
        """The shard of each entry: all of one prefix and part go to the same."""
        out = [self._shard(lang, prefixes[i : i + ENTRIES], nexts[i : i + ENTRIES]) for i in range(0, len(prefixes), ENTRIES)]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)

    def _shard(self, lang: str, prefixes: pa.Array, nexts: pa.Array) -> np.ndarray:
        before, after = prefixes.dictionary_encode(), nexts.dictionary_encode()
        names = before.dictionary.to_pylist()
        parts = self.of(lang, names)[before.indices.to_numpy()]
        hashes = word_hashes(names)[before.indices.to_numpy()]
        sums = np.array([zlib.crc32(w.encode()) for w in after.dictionary.to_pylist()], dtype=np.int64)
        part = (sums[after.indices.to_numpy()] % parts).astype(np.uint64)
        return (mixed(hashes * MIX + part) % np.uint64(self.shards)).astype(np.int32)


def prepared(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def frequent_buckets(docs: DataFrame, at_least: int, bits: int = BITS, pairs=None) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits of the buckets that hold at least so many runs, over all texts of (lang, text), and counts of words by bucket.

    Runs are pairs or, with a broadcast of the pairs' bits, the longer ones; then words are not counted again.
    """
    kind = np.dtype(np.uint8 if at_least < 128 else np.uint32)
    block = min(BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counters stop at at_least, so a byte is enough for small ones.
        counters = np.zeros(1 << bits, dtype=kind)
        words = np.zeros(1 << WORD_BITS, dtype=np.int64)
        for batch in freed(batches):
            for found in by_language(batch):
                if not pairs:
                    add_words(words, *found)
                places, n = np.unique(counted_buckets(*found, bits, pairs.value if pairs else None), return_counts=True)
                counters[places] = np.minimum(counters[places] + np.minimum(n, at_least), at_least).astype(kind)
        for k in range(len(counters) // block):
            part = counters[k * block : (k + 1) * block]
            filled = np.flatnonzero(part)
            if len(filled):
                at, n = filled.astype(np.uint16).tobytes(), part[filled].tobytes()
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "at": [at], "n": [n]})
        # Blocks below 0 hold words.
        for k in range(len(words) // BLOCK):
            part = words[k * BLOCK : (k + 1) * BLOCK]
            filled = np.flatnonzero(part)
            if len(filled):
                at, n = filled.astype(np.uint16).tobytes(), part[filled].tobytes()
                yield pa.RecordBatch.from_pydict({"block": pa.array([-1 - k], pa.int32()), "at": [at], "n": [n]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, np.zeros(BLOCK, dtype=np.int64)

        def done() -> pa.RecordBatch:
            packed = (sums if current < 0 else np.packbits(sums[:block] >= at_least)).tobytes()
            return pa.RecordBatch.from_pydict({"block": pa.array([current], pa.int32()), "bits": [packed]})

        for batch in batches:
            for k, at, n in zip(*(column.to_pylist() for column in batch.columns)):
                if k != current:
                    if current is not None:
                        yield done()
                    current = k
                    sums[:] = 0
                sums[np.frombuffer(at, dtype=np.uint16)] += np.frombuffer(n, dtype=np.int64 if k < 0 else kind)
        if current is not None:
            yield done()

    counted = docs.mapInArrow(count, "block int, at binary, n binary")
    rows = counted.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary").collect()
    out, words = np.zeros((1 << bits) // 8, dtype=np.uint8), np.zeros(1 << WORD_BITS, dtype=np.int64)
    for k, packed in rows:
        if k < 0:
            words[(-1 - k) * BLOCK : -k * BLOCK] = np.frombuffer(packed, dtype=np.int64)
        else:
            out[k * block // 8 : (k + 1) * block // 8] = np.frombuffer(packed, dtype=np.uint8)
    return out, words


def add_words(counts: np.ndarray, lang: str, codes: np.ndarray, vocabulary: pa.Array) -> None:
    hashes = word_hashes(vocabulary.to_pylist(), xxhash.xxh3_64_intdigest(lang.encode()))
    n = np.bincount(codes[codes >= 0], minlength=len(hashes))
    np.add.at(counts, (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), n)


def windows(codes: np.ndarray, vocabulary: pa.Array, extended: list[np.ndarray]) -> pa.Table:
    """level, prefix, next, n of the windows of some texts."""
    size, parts = len(vocabulary), []
    texts = pa.array([""], pa.large_string())
    places = np.flatnonzero(codes >= 0)
    ids = np.zeros(len(places), dtype=np.int64)
    for level in range(LONGEST):
        found, ids = np.unique(ids * size + codes[places + level], return_inverse=True)
        parents, words = pa.array(found // size), pa.array(found % size)
        prefix, word = texts.take(parents), vocabulary.take(words)
        texts = pc.binary_join_element_wise(prefix, word, pa.scalar(" ", word.type)) if level else word
        more = extended[level][places] if level + 1 < LONGEST else np.zeros(len(places), dtype=bool)
        ended = np.bincount(ids[~more], minlength=len(found))
        table = pa.table({"level": pa.array(np.full(len(found), level, dtype=np.int32)), "prefix": prefix, "next": word, "n": pa.array(ended)})
        parts.append(table.filter(pa.array(ended > 0)))
        places, ids = places[more], ids[more]
    return pa.concat_tables(parts)


def stripes(docs: DataFrame, pairs, longer, words, bits: int = BITS) -> DataFrame:
    """Rows STRIPES of what each task read; pairs, longer and words: broadcasts of frequent_buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Parts(words.value)
        for batch in freed(batches):
            for lang in batch.column(0).unique().to_pylist():
                own, parts, rows = batch.filter(pc.equal(batch.column(0), lang)), [], 0
                for _, codes, vocabulary in by_language(own):
                    parts.append(windows(codes, vocabulary, extensions(lang, codes, vocabulary, bits, pairs.value, longer.value)))
                    rows += len(parts[-1])
                    if rows > ROWS:
                        parts = [added(parts)]
                        rows = 0
                yield from rows_of(lang, added(parts), deal)

    def added(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["level", "prefix", "next"]).aggregate([("n", "sum")]).rename_columns(["level", "prefix", "next", "n"])

    def rows_of(lang: str, table: pa.Table, deal: Parts) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        table = table.append_column("shard", pa.array(deal.shard(lang, *(table[c].combine_chunks() for c in ("prefix", "next")))))
        out = table.group_by(["level", "shard"]).aggregate([(c, "list") for c in ("prefix", "next", "n")])
        strings = pa.list_(pa.string())
        out = pa.table(
            {
                "lang": pa.array([lang] * len(out), pa.string()), "level": out["level"], "shard": out["shard"],
                "prefix": out["prefix_list"].cast(strings), "next": out["next_list"].cast(strings), "n": out["n_list"],
            }
        )
        yield from out.to_batches(5_000)

    return docs.mapInArrow(run, STRIPES)


def merge_stripes(rows: DataFrame, at_least: int, words) -> DataFrame:
    """Stripes added elementwise: rows MERGED with the total of each part of a stripe, its entries of at least so much, and
    the entry of the stripe one word shorter that the total goes to."""
    keys, cells = ["lang", "level", "shard"], ["prefix", "next", "n"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip([*keys, *cells], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, held = Parts(words.value), None
        for batch in freed(batches):
            if len(batch):
                table = pa.Table.from_batches([batch]).cast(schema)
                done, held = added(pa.concat_tables([held, table]) if held is not None else table)
                yield from finished(*done, deal)
        if held is not None:
            done, _ = added(held, last=True)
            yield from finished(*done, deal)

    def added(table: pa.Table, last: bool = False):
        """Merged entries of all shards but the last, which is held as one row."""
        table = table.combine_chunks()
        fresh = np.zeros(len(table), dtype=bool)
        for k in keys:
            column = table[k].combine_chunks()
            fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        ids = np.cumsum(fresh)
        first = table.select(keys).take(pa.array(np.flatnonzero(np.concatenate([[True], fresh[1:]]))))
        lists = {c: table[c].combine_chunks() for c in cells}
        of = ids[pc.list_parent_indices(lists["n"]).to_numpy()]
        sums = pa.table({"id": of, **{c: x.flatten() for c, x in lists.items()}})
        sums = sums.group_by(["id", "prefix", "next"]).aggregate([("n", "sum")]).rename_columns(["id", *cells])
        n_done = len(first) if last else len(first) - 1
        rest = sums.filter(pc.equal(sums["id"], n_done))
        held = None
        if not last:
            whole = {c: pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest[c].combine_chunks()) for c in cells}
            held = pa.table({**{k: first[k].slice(n_done) for k in keys}, **whole}).cast(schema)
        return (first.slice(0, n_done), sums.filter(pc.less(sums["id"], n_done))), held

    def finished(first: pa.Table, sums: pa.Table, deal: Parts) -> Iterator[pa.RecordBatch]:
        if not len(sums):
            return
        # One row per shard and prefix.
        sums = sums.combine_chunks()
        coded = sums["prefix"].combine_chunks().dictionary_encode()
        code = sums["id"].to_numpy() * len(coded.dictionary) + coded.indices.to_numpy()
        found, of = np.unique(code, return_inverse=True)
        totals = np.zeros(len(found), dtype=np.int64)
        np.add.at(totals, of, sums["n"].to_numpy())
        large = np.flatnonzero(sums["n"].to_numpy() >= at_least)
        large = large[np.argsort(of[large], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(of[large], minlength=len(found)))]).astype(np.int32)
        lists = {c: pa.ListArray.from_arrays(pa.array(ends), sums[c].combine_chunks().take(pa.array(large))) for c in ("next", "n")}
        names = coded.dictionary
        del sums, coded, code, of
        for i in range(0, len(found), ENTRIES):
            some = found[i : i + ENTRIES]
            prefixes, own = names.take(pa.array(some % len(names))), first.take(pa.array(some // len(names)))
            up = [prefix.rsplit(" ", 1) if " " in prefix else ["", prefix] for prefix in prefixes.to_pylist()]
            shorter, last = (pa.array(list(c), pa.string()) for c in zip(*up))
            shards, langs = np.zeros(len(some), dtype=np.int32), own["lang"].combine_chunks()
            for lang in langs.unique().to_pylist():
                at = pa.array(np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False)))
                shards[at.to_numpy()] = deal.shard(lang, shorter.take(at), last.take(at))
            columns = {**{k: own[k] for k in keys}, "prefix": prefixes, "total": pa.array(totals[i : i + ENTRIES])}
            columns |= {c: x.slice(i, len(some)) for c, x in lists.items()}
            yield from pa.table({**columns, "up_prefix": shorter, "up_next": last, "up_shard": pa.array(shards)}).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, MERGED)


def merged_levels(docs: DataFrame, at_least: int, bits: int = BITS) -> list[DataFrame]:
    """Merged stripes by the number of words in the prefix, none first; (lang, text) in."""
    context = docs.sparkSession.sparkContext
    pairs, words = map(context.broadcast, frequent_buckets(docs, at_least, bits))
    longer = context.broadcast(frequent_buckets(docs, at_least, bits, pairs)[0])
    emitted = materialise(stripes(docs, pairs, longer, words, bits), "stripes")
    out: list[DataFrame] = []
    for level in reversed(range(LONGEST)):
        rows = emitted.where(F.col("level") == level)
        if out:
            up = [F.col("up_shard").alias("shard"), F.array("up_prefix").alias("prefix"), F.array("up_next").alias("next"), F.array("total").alias("n")]
            rows = rows.unionByName(out[0].select("lang", F.lit(level).alias("level"), *up))
        out.insert(0, materialise(merge_stripes(rows, at_least, words), f"stripes-{level}"))
    return out


def collocations(
    docs: DataFrame, at_least: int = 100, subsumed: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", bits: int = BITS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two to five words of each language.

    a, l and r are the counts of the phrase and of both parts at its lowest-scoring cut, n the number of all words;
    score = floor(1000 a n / (l r)). Phrases that stand in a longer one with at least ``subsumed`` percent of their count are dropped.
    """
    levels = merged_levels(prepared(docs, text, lang), at_least, bits)
    entries = [part.select("lang", "prefix", F.explode(F.arrays_zip("next", "n")).alias("e")) for part in levels]
    counts = None
    for level, part in enumerate(entries):
        phrase = F.concat_ws(" ", "prefix", "e.next") if level else F.col("e.next")
        rows = part.select("lang", phrase.alias("phrase"), F.lit(level + 1).alias("words"), F.col("e.n").alias("a"))
        counts = rows if counts is None else counts.unionByName(rows)
    counts = materialise(counts, "phrases")
    # Longer phrases: by one more word behind, the largest entry of the phrase's own stripe; by one before, from theirs.
    longer = None
    for level in range(2, LONGEST):
        behind = levels[level].select("lang", F.col("prefix").alias("phrase"), F.array_max("n").alias("most")).where("most IS NOT NULL")
        longer = behind if longer is None else longer.unionByName(behind)
    words = F.split("phrase", " ")
    before = counts.where("words > 2").select("lang", F.array_join(F.slice(words, 2, LONGEST), " ").alias("phrase"), F.col("a").alias("most"))
    longer = longer.unionByName(before).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = counts.where("words > 1").join(longer, ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < subsumed * F.col("a").cast("decimal(20,0)")))

    k = F.col("k")
    cuts = kept.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), k), " ").alias("first"),
        F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("rest"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"),
    )
    known = counts.where(F.col("words") < LONGEST).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    left = known.select("lang", F.col("phrase").alias("first"), "salt", F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), "salt", F.col("a").alias("r"))
    sizes = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    scored = cuts.join(left, ["lang", "first", "salt"]).join(right, ["lang", "rest", "salt"]).join(sizes, "lang")

    score = F.expr("CAST((1000 * (CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("best"))
    ranked = lowest.select("lang", "phrase", *[F.col(f"best.{c}") for c in ("a", "l", "r", "n", "score")])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # Of a large language, only the first of each share meet in one task.
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    ranked = ranked.withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed
), counted AS (
  SELECT lang, k AS words, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a
  FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), sizes AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM listed GROUP BY lang
), longer AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS part, max(a) AS most
  FROM (SELECT lang, words, a, string_split(phrase, ' ') AS w FROM counted WHERE words > 2),
    (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(2, 5)) AS k)
  WHERE k < words AND i + k - 1 <= words GROUP BY ALL
), kept AS (
  SELECT c.* FROM counted c LEFT JOIN longer l ON l.lang = c.lang AND l.part = c.phrase
  WHERE words > 1 AND (most IS NULL OR 100 * most < 100 * a)
), cuts AS (
  SELECT lang, phrase, a, words, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS w FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, k, 1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN sizes USING (lang)
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : k], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 : c.words], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""
