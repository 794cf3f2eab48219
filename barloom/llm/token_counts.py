"""Token counts of whole texts by a two-tier lookup on the map side.

A text is cut where no piece of the sentencepiece model can reach across: before white space that follows
another character, and around newlines. Between these cuts the library's merges never meet, so the text has as
many tokens as its pre-tokens together. The first tier is a compact table of frequent pre-tokens and their lengths, which every
task gets by broadcast and looks up column by column. The second tier is a cache in each worker: what the
table misses is encoded by the library once and kept. No pre-token is shuffled; only each task's summary of its most
frequent ones is (``SUMMARY`` rows a task), and from all summaries the table is chosen.

The summaries cover all texts (Misra-Gries counts, which merge by addition). They decide speed only: the counts are
the same whatever the table holds. The table has at most ``TABLE`` entries of at most ``ENTRY_BYTES`` bytes each,
which bounds the broadcast and what the driver sees at 1.5 MB.

Defined results: a null or empty text has no bytes and no tokens; repeated rows give repeated rows; a null doc_id keeps its
row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import chunks

MODEL = "piece_bpe_32k.model"
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"
TABLE, ENTRY_BYTES = 32_768, 40
#: Pre-tokens that a task's summary keeps between chunks and hands over.
KEPT, SUMMARY = 65_536, 8_192
#: Pre-tokens that a worker's cache holds, and the longest of them in characters.
CACHE, CACHE_CHARS = 200_000, 60
LIMIT = 4096


class PieceCounter:
    """Counts the tokens of pre-tokens with one sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        pieces = [p for i, p in enumerate(pieces) if not self.model.is_byte(i) and not self.model.is_control(i)]
        #: False for a model with pieces that run across the cuts; its texts are counted whole.
        self.cuts = not any(len(p) > 1 and ("\n" in p or SPACE in p.lstrip(SPACE)) for p in pieces) and (
            len(self.model.encode("\n")) == 2 and len(self.model.encode(" a  b \n")) == len(self.model.encode(" a  b ")) + 1
        )
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def encoded(self, units: list[str]) -> list[int]:
        """Lengths of pre-tokens. Behind a newline they stand as they are, without the space the library puts first."""
        return [n - 2 for n in self.whole(["\n" + unit for unit in units])]

    def lengths(self, units: list[str]) -> list[int]:
        """Lengths of pre-tokens through the cache."""
        known = self.known
        new = [u for u in units if u not in known]
        if len(known) + len(new) > CACHE:
            known.clear()
            new = units
        known.update(zip(new, self.encoded(new)))
        found = [known[u] for u in units]
        for unit in new:
            if len(unit) > CACHE_CHARS:
                known.pop(unit, None)
        return found


@functools.cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def pretokens(texts: pa.Array) -> pa.ListArray:
    """The pre-tokens of texts (no nulls), with SPACE for spaces, and empty ones between newlines."""
    marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(SPACE, texts.type), texts, pa.scalar("", texts.type)), " ", SPACE)
    return pc.split_pattern(pc.replace_substring_regex(marked, f"([^{SPACE}\\n]){SPACE}", f"\\1\n{SPACE}"), "\n")


def summaries(docs: DataFrame, text: str = "text") -> DataFrame:
    """unit, n: the most frequent pre-tokens of each task with at least as many occurrences, and no more than true ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"unit": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})
        for batch in batches:
            column = batch.column(0)
            for start, stop in chunks(column.to_pylist()):
                units = pretokens(column.slice(start, stop - start).cast(pa.large_string())).values
                found = pc.value_counts(units)
                part = pa.table({"unit": found.field("values"), "n": found.field("counts")})
                part = part.filter(pc.and_(pc.less_equal(pc.binary_length(part["unit"]), ENTRY_BYTES), pc.not_equal(part["unit"], "")))
                held = pa.concat_tables([held, part]).group_by("unit").aggregate([("n", "sum")]).rename_columns(["unit", "n"])
                if len(held) > KEPT:
                    # Misra-Gries: the counts left are too small by what the largest dropped one had.
                    counts = held["n"].to_numpy()
                    floor = int(np.partition(counts, len(counts) - KEPT - 1)[len(counts) - KEPT - 1])
                    held = held.filter(pc.greater(held["n"], floor))
                    held = held.set_column(1, "n", pc.subtract(held["n"], floor))
        top = pc.select_k_unstable(held, SUMMARY, [("n", "descending")]) if len(held) else []
        out = held.take(top) if len(top) else held
        yield pa.RecordBatch.from_arrays([out["unit"].combine_chunks().cast(pa.string()), out["n"].combine_chunks()], ["unit", "n"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "unit string, n long")


def frequent_lengths(docs: DataFrame, text: str = "text", model: str | None = None, entries: int = TABLE) -> tuple[pa.Array, pa.Array]:
    """The first tier: frequent pre-tokens of all texts and their lengths, at most ``entries`` of them."""
    counted = summaries(docs, text).groupBy("unit").agg(F.sum("n").alias("n"))
    units = [r["unit"] for r in counted.orderBy(F.desc("n"), "unit").limit(entries).select("unit").collect()]
    found = counter(_path(model)).encoded(units) if units else []
    return pa.array(units, pa.large_string()), pa.array(found, pa.int32())


def _path(model: str | None) -> str:
    return model or public_tokenizers.path(MODEL)


def token_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, limit: int = LIMIT, entries: int = TABLE
) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every whole text, as the sentencepiece model counts them."""
    path = _path(model)
    cuts = counter(path).cuts
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, model, entries) if cuts else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(_path(model))
        for batch in batches:
            column, found = batch.column(1), []
            for start, stop in chunks(texts := column.to_pylist()):
                if not cuts:
                    found += pieces.whole(texts[start:stop])
                    continue
                part = column.slice(start, stop - start).cast(pa.large_string())
                lists = pretokens(part)
                units, starts = lists.values, lists.offsets.to_numpy().astype(np.int64)
                frequent, lengths = table.value
                at = pc.index_in(units, value_set=frequent)
                counts = pc.fill_null(pc.take(lengths, at), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                missed = pc.and_(pc.is_null(at), pc.not_equal(units, ""))
                places = np.flatnonzero(missed.to_numpy(zero_copy_only=False))
                if len(places):
                    coded = units.take(pa.array(places)).dictionary_encode()
                    counts[places] = np.array(pieces.lengths(coded.dictionary.to_pylist()))[coded.indices.to_numpy()]
                sums = np.concatenate([[0], np.cumsum(counts)])
                newlines = pc.count_substring(part, "\n").to_numpy(zero_copy_only=False)
                total = sums[starts[1:]] - sums[starts[:-1]] + newlines
                # The library puts no space before an empty text.
                found += np.where(pc.equal(part, "").to_numpy(zero_copy_only=False), 0, total).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(column).cast(pa.int64()), pa.array(found, pa.int64())], ["key", "n_bytes", "n_tokens"]
            )
        # The worker lives on after its task.
        pieces.known.clear()

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = chosen.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
