"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Every byte stands for one printable character (the byte table below), so the library's BPE model works on
ordinary strings. Merges are derived from the rank file: each way of cutting a token into two tokens is a
merge with that token's rank. The pre-tokenizer splits a text by the pattern and maps the bytes of each
match; offsets are in characters of the text. Decoding turns token characters back into bytes and joins
the bytes before reading UTF-8, so a character split over several tokens comes back whole.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated
rows; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

RANKS = "byte_bpe_50k.tiktoken"
#: Characters that one call of the library gets at most, unless a single text has more.
CHUNK_CHARS = 1 << 20
#: White space beside white space, and the places between matches for texts that have it.
TWO_SPACES = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")


@functools.cache
def byte_table() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@functools.cache
def tokens(path: str) -> list[bytes]:
    """The bytes of each token, by id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@functools.cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    table = byte_table()
    shown = ["".join(table[b] for b in token) for token in tokens(path)]
    vocab = {token: i for i, token in enumerate(shown) if token}
    merges = [
        (token[:cut], token[cut:])
        for token in shown
        for cut in range(1, len(token))
        if token[:cut] in vocab and token[cut:] in vocab
    ]
    model = Tokenizer(models.BPE(vocab, merges, cache_capacity=0))
    model.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return model


def encode_texts(texts: list[str], path: str, pattern: str, offsets: bool = False):
    """The library's encoding of each text, called for a bounded number of characters at a time."""
    model = tokenizer(path, pattern)
    call = model.encode_batch if offsets else model.encode_batch_fast
    start = 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= CHUNK_CHARS):
            chars += len(texts[stop])
            stop += 1
        yield from call(texts[start:stop], add_special_tokens=False)
        start = stop


class UnitEncoder:
    """Encodes texts unit by unit, and keeps the ids of units that come again.

    A match of the pattern never runs over a space whose left neighbour is no white space, nor over a last
    space before a word; there a text can be cut, and the units have the ids they have in the whole text.
    """

    def __init__(self, path: str, pattern: str, entries: int = 400_000, unit_chars: int = 40):
        self.path, self.pattern, self.entries, self.unit_chars = path, pattern, entries, unit_chars
        self.known: dict[str, bytes] = {}
        self.lengths = np.array([len(token) for token in tokens(path)])

    def units(self, text: str) -> list[str]:
        if TWO_SPACES.search(text):
            return CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + part for part in rest]]

    def coded(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each unit with its ids. Units that may stand side by side go through the library as one text."""
        side, alone = [], []
        for unit in units:
            joins = len(unit) > 1 and unit[0] == " " and not unit[1].isspace() and not unit[-1].isspace()
            (side if joins else alone).append(unit)
        for unit, found in zip(alone, encode_texts(alone, self.path, self.pattern)):
            yield unit, np.array(found.ids, dtype="<u4").tobytes()
        if side:
            found = next(iter(encode_texts(["".join(side)], self.path, self.pattern)))
            ids = np.array(found.ids, dtype="<u4")
            ends = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(unit.encode()) for unit in side])) + 1
            joined, start = ids.tobytes(), 0
            for unit, stop in zip(side, (4 * cuts).tolist()):
                yield unit, joined[start:stop]
                start = stop

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        start = 0
        while start < len(texts):
            parts, chars, new = [], 0, set()
            while start < len(texts) and chars < CHUNK_CHARS:
                parts.append(self.units(texts[start]))
                new.update(parts[-1])
                chars += len(texts[start])
                start += 1
            known = self.known
            if len(known) > self.entries:
                known.clear()
            known.update(self.coded(list(new.difference(known))))
            yield from (b"".join([known[u] for u in units]) for units in parts)
            for unit in new:
                if len(unit) > self.unit_chars:
                    known.pop(unit, None)


@functools.cache
def unit_encoder(path: str, pattern: str) -> UnitEncoder:
    return UnitEncoder(path, pattern)


def decode_ids(ids, path: str) -> bytes:
    table = tokens(path)
    return b"".join([table[i] for i in ids])


def _path(vocabulary: str | None) -> str:
    return vocabulary or public_tokenizers.path(RANKS)


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None
) -> DataFrame:
    """key, ids, starts, ends: token ids with the character offsets that each covers."""
    path, pattern = vocabulary, pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(encode_texts(batch.column(1).to_pylist(), _path(path), pattern, offsets=True))
            spans = [np.array(e.offsets, dtype=np.int32).reshape(-1, 2) for e in found]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([e.ids for e in found], ints),
                    pa.array([s[:, 0] for s in spans], ints),
                    pa.array([s[:, 1] for s in spans], ints),
                ],
                ["key", "ids", "starts", "ends"],
            )

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = chosen.mapInArrow(run, f"key {kind}, ids array<int>, starts array<int>, ends array<int>")
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """key, bytes, text: the decoded bytes, and their text (bytes that are no UTF-8 become U+FFFD)."""
    path = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode_ids(x or (), _path(path)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(found, pa.binary()),
                    pa.array([x.decode("utf-8", "replace") for x in found], pa.string()),
                ],
                ["key", "bytes", "text"],
            )

    kind = encoded.schema[key].dataType.simpleString()
    chosen = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return chosen.mapInArrow(run, f"key {kind}, bytes binary, text string").withColumnRenamed("key", key)


def tokenised(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None
) -> DataFrame:
    """key, n_tokens, ids, same: the ids of every text, and whether they decode to its bytes."""
    path, pattern = vocabulary, pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, encoder, table = batch.column(1).to_pylist(), unit_encoder(_path(path), pattern), _path(path)
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in encoder.ids(texts)]
            same = [decode_ids(x.tolist(), table) == t.encode() for x, t in zip(ids, texts)]
            counts = np.array([len(x) for x in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                ["key", "n_tokens", "ids", "same"],
            )
        # The worker lives on after its task.
        unit_encoder(_path(path), pattern).known.clear()

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = chosen.mapInArrow(run, f"key {kind}, n_tokens long, ids array<int>, same boolean")
    return out.withColumnRenamed("key", key)


def digests(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None
) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding every text, in one pass."""
    path, pattern = vocabulary, pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, coded, decoded = [], [], []
            encoder = unit_encoder(_path(path), pattern)
            for ids in encoder.ids(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                back = decode_ids(np.frombuffer(ids, dtype="<u4").tolist(), _path(path))
                decoded.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        # The worker lives on after its task.
        unit_encoder(_path(path), pattern).known.clear()

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = chosen.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
