"""Substring dedup: passages of documents that already stand in earlier documents.

Confirm: in every window of ``window`` words the phrase (``PHRASE`` words) with the smallest hash is its anchor, so equal
windows have equal anchors. Neighbouring windows with one anchor form a block. A phrase whose anchors stand
in two documents or more recurs; equal blocks of it are one class with a first document.

Locate: documents are dealt into shards. The recurring phrases that occur in a shard are compiled into its Aho-Corasick
automaton, over word codes, and every document of the shard is streamed through it. An automaton thus never
holds more than the text beside it, and each document passes one automaton, however many passages recur.

Decide: where all blocks of a phrase are equal, their first document decides for all their windows. Where
they differ, the windows of one block of each class are compared by their hashes.

Defined results: a null text has no words; texts shorter than a window lose nothing; a passage repeated
within one document only stays; rows with one doc_id are texts of one document, each with a row of its
own in the result; rows with a null doc_id neither lose words nor make others lose any; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.shared import materialise
from barloom.llm.words import MIX, chunks, coded_words, mixed, word_hashes

PHRASE = 10
#: Blocks of a shard, about: some 20 words each.
SHARD_BLOCKS = 20_000
ODD = 0xD6E8FEB86659FD93


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = pow(ODD, -1, 1 << 64)
    grown = [np.full(n + 1, x, dtype=np.uint64) for x in (ODD, inverse)]
    for x in grown:
        x[0] = 1
    return tuple(np.multiply.accumulate(x) for x in grown)


class Blocks:
    """Blocks of a chunk of texts: text, start and stop of their windows, anchor's place and hashes."""

    def __init__(self, texts: list[str], window: int):
        self.window = window
        self.codes, self.starts, vocabulary = coded_words(texts)
        hashes = word_hashes(vocabulary)[self.codes] if len(self.codes) else np.zeros(0, dtype=np.uint64)
        up, self.down = powers(1 << max(1, len(hashes)).bit_length())
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
        lengths = np.diff(self.starts)
        grams = self.hashed(np.arange(max(0, len(hashes) - PHRASE + 1)), PHRASE)
        picked = smallest(grams, window - PHRASE + 1)
        whole = np.repeat(self.starts[1:] - window, lengths)
        first = np.flatnonzero(np.arange(len(hashes)) <= whole)
        text = np.repeat(np.arange(len(lengths)), lengths)[first]
        anchor = picked[first]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(first)) - 1 if len(begin) else begin
        self.text, self.place, self.start, self.last = text[begin], anchor[begin], first[begin], first[last]
        self.anchor = grams[self.place] if len(begin) else np.zeros(0, dtype=np.uint64)
        size = self.last + window - self.start
        shape = mixed((self.place - self.start).astype(np.uint64) * MIX + size.astype(np.uint64))
        self.block = mixed(self.hashed(self.start, size) ^ shape)

    def once(self) -> np.ndarray:
        """The first of equal blocks of a text; a text that goes round in a circle has very many."""
        order = np.lexsort((self.block, self.anchor, self.text))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (np.diff(self.text[order]) == 0) & (np.diff(self.anchor[order]) == 0) & (np.diff(self.block[order]) == 0)
        return np.sort(order[~same])

    def hashed(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of the word sequences of that size from those starts on."""
        return mixed((self.sums[start + size] - self.sums[start]) * self.down[start])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest (last of equals) of each ``width`` neighbours."""
    index = np.arange(len(values))
    if len(values) < width:
        return index[:0]

    def joined(index, step):
        left, right = index[:-step], index[step:]
        return np.where(values[right] <= values[left], right, left)

    reach = 1
    while 2 * reach <= width:
        index = joined(index, reach)
        reach *= 2
    return joined(index, width - reach) if width > reach else index


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def blocks(docs: DataFrame, window: int) -> DataFrame:
    """anchor, block, doc_id, place (the anchor's first word) of every distinct block of a text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            ids = frame["doc_id"].to_numpy()
            for start, stop in chunks(texts):
                b = Blocks(texts[start:stop], window)
                once = b.once()
                text = b.text[once]
                yield pd.DataFrame(
                    {
                        "anchor": b.anchor[once].view(np.int64),
                        "block": b.block[once].view(np.int64),
                        "doc_id": ids[start:stop][text],
                        "place": (b.place[once] - b.starts[text]).astype(np.int32),
                    }
                )

    return docs.mapInPandas(run, f"anchor long, block long, doc_id {_kind(docs)}, place int")


def recurring(found: DataFrame, shards: int) -> DataFrame:
    """Per shard the classes of recurring phrases in it, each with a document and place to cut the phrase from."""
    ends = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    again = materialise(found.join(ends.select("anchor"), "anchor").withColumn("shard", shard_of(shards)), "recurring")
    classes = again.groupBy("anchor", "block").agg(F.min("doc_id").alias("first"))
    many = classes.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("many"))
    classes = classes.join(many, "anchor")
    here = again.groupBy("anchor", "block", "shard").agg(F.min("doc_id").alias("doc_id"), F.min_by("place", "doc_id").alias("place"))
    return here.join(classes, ["anchor", "block"])


def shard_of(shards: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")


def automaton(phrases: set[tuple[int, ...]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        out.add_word(phrase)
    out.make_automaton()
    return out


def located(texts: pd.DataFrame, known: pd.DataFrame, window: int) -> Iterator[tuple]:
    """Occurrences of a shard's recurring phrases: doc_id, copy, anchor, block, starts, at, windows.

    A row is a block of a text with all its starts. at numbers the windows that repeat; it is null where the phrase has
    several classes, and windows then holds the hashes of the first document of each.
    """
    if not len(known) or not len(texts):
        return
    b = Blocks(texts["text"].tolist(), window)
    row_of: dict = {}
    for row, doc_id in enumerate(texts["doc_id"].tolist()):
        row_of.setdefault(doc_id, []).append(row)
    classes, phrases = {}, set()
    codes = b.codes.tolist()
    starts = b.starts.tolist()
    anchors = known["anchor"].to_numpy().view(np.uint64)
    columns = zip(anchors, known["anchor"], known["block"], known["doc_id"], known["place"], known["first"], known["many"])
    for value, anchor, block, doc_id, place, first, many in columns:
        classes[anchor, block] = first, many
        for row in row_of[doc_id]:
            at = starts[row] + place
            if at + PHRASE <= starts[row + 1] and b.hashed(np.array([at]), PHRASE)[0] == value:
                phrases.add(tuple(codes[at : at + PHRASE]))
                break
    machine = automaton(phrases)
    hit = np.zeros(len(codes) + 1, dtype=bool)
    for row in range(len(texts)):
        words = tuple(codes[starts[row] : starts[row + 1]])
        if len(words) >= PHRASE:
            ends = [end for end, _ in machine.iter(words)]
            hit[starts[row] + np.array(ends, dtype=np.int64) - (PHRASE - 1)] = True
    ids, copies = texts["doc_id"].tolist(), texts["copy"].tolist()
    found: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(hit[b.place]).tolist():
        key = int(b.text[i]), int(b.anchor[i].view(np.int64)), int(b.block[i].view(np.int64))
        if key[1:] in classes:
            found.setdefault(key, []).append(i)
    for (row, *key), places in found.items():
        first, many = classes[tuple(key)]
        if not many and first >= ids[row]:
            continue
        begin = (b.start[places] - starts[row]).tolist()
        at = np.arange(b.last[places[0]] - b.start[places[0]] + 1)
        windows = b.hashed(b.start[places[0]] + at, window).view(np.int64).tolist() if many and ids[row] == first else None
        yield ids[row], copies[row], *key, begin, None if many else at.tolist(), windows


def occurrences(docs: DataFrame, phrases: DataFrame, window: int, shards: int) -> DataFrame:
    kind = _kind(docs)
    names = ["doc_id", "copy", "anchor", "block", "starts", "at", "windows"]

    def run(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(located(texts, known, window)), columns=names)

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"), shard_of(shards).alias("shard"))
    return (
        dealt.groupBy("shard")
        .cogroup(phrases.groupBy("shard"))
        .applyInPandas(
            run,
            f"doc_id {kind}, copy long, anchor long, block long, starts array<int>, at array<int>, windows array<long>",
        )
    )


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, copy (hash of the text), starts, at: windows that repeat earlier documents, as lists of sums."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = materialise(blocks(texts, window), "blocks")
    shards = max(1, -(-found.count() // SHARD_BLOCKS))
    all_of = materialise(occurrences(texts, recurring(found, shards), window, shards), "occurrences")

    direct = all_of.where("at is not null").select("doc_id", "copy", "starts", "at")
    # Windows of phrases with several classes: the first document of each window, then of each class's windows.
    each = all_of.where("windows is not null").dropDuplicates(["anchor", "block"])
    each = materialise(each.select("anchor", "block", "doc_id", F.posexplode("windows").alias("at", "hash")), "windows")
    firsts = each.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"))
    by_class = each.join(firsts, ["anchor", "hash"]).groupBy("anchor", "block").agg(
        F.collect_list(F.struct("at", firsts["first"])).alias("windows")
    )
    open_ = all_of.where("at is null").select("doc_id", "copy", "anchor", "block", "starts")
    earlier = F.filter("windows", lambda w: w["first"] < F.col("doc_id"))
    told = open_.join(by_class, ["anchor", "block"]).select("doc_id", "copy", "starts", earlier["at"].alias("at"))
    spans = direct.union(told.where("size(at) > 0")).groupBy("doc_id", "copy")
    return spans.agg(F.collect_list("starts").alias("starts"), F.collect_list("at").alias("at"))


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row."""
    return _finished(docs, window, "kept string", lambda kept: kept.decode("utf-8", "replace"))


def digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return _finished(docs, window, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _finished(docs: DataFrame, window: int, column: str, shown) -> DataFrame:
    name = column.split()[0]
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64("text").alias("copy"))
    joined = texts.join(repeats(docs, window), ["doc_id", "copy"], "left").select(
        "doc_id", "text", "starts", "at"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, starts, at in zip(frame["doc_id"], frame["text"], frame["starts"], frame["at"]):
                words = text.encode().split()
                kept = words
                if starts is not None:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    for some, windows in zip(starts, at):
                        begin = np.add.outer(some, windows).ravel()
                        np.add.at(edges, begin, 1)
                        np.add.at(edges, begin + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                out.append((doc_id, len(words), len(words) - len(kept), shown(b" ".join(kept))))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", name])

    return joined.mapInPandas(run, f"doc_id {_kind(docs)}, n_words long, n_removed long, {column}")
