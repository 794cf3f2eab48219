"""Document fingerprints by Order MinHash, and their likeness between neighbouring and edited texts.

A text is cut into pieces of at most ``PIECE`` characters without white space; k consecutive pieces are a
k-mer, numbered by how often it occurred before. For each of m hash functions the ``length`` smallest
numbered k-mers are selected, put back into text order and hashed as a tuple. Two fingerprints are as like
as the share of their tuples that agree, which falls with the edit distance of the texts: repeats count
through the numbering, and moved passages through the order.

Defined results: a null text counts as empty; texts without pieces have a fingerprint of their own, and
are alike to each other (1) and to nothing else (0); texts with fewer k-mers than a tuple needs hash those they
have. Rows go by ascending doc_id (null first), then text; the row after the last is the first, so a single
row is its own next. Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M, K, LENGTH, PIECE = 96, 2, 2, 8
PIECES = re.compile(r"[^\x20\x09-\x0D]{1,%d}" % PIECE)
#: Rows of a shard, about; a shard is what one call of the shard function holds.
ROWS = 500
#: Values hashed at a time.
BLOCK = 1 << 18

_random = np.random.default_rng(20240607)
FACTORS = _random.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Fingerprints:
    """Fingerprints of texts; remembers the hashes of pieces seen lately."""

    def __init__(self, m: int = M, k: int = K, length: int = LENGTH, entries: int = 300_000):
        self.m, self.k, self.length, self.entries = m, k, length, entries
        self.known: dict[str, int] = {}

    def numbered(self, text: str) -> np.ndarray:
        """Hashes of the k-mers with their occurrence numbers, in text order."""
        pieces = PIECES.findall(text)
        known = self.known
        if len(known) > self.entries:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = xxhash.xxh3_64_intdigest(piece.encode())
        codes = np.array([known[p] for p in pieces], dtype=np.uint64)
        if not len(codes):
            return codes
        k = min(self.k, len(codes))
        grams = codes[: len(codes) - k + 1].copy()
        for j in range(1, k):
            grams = mixed(grams * MIX + codes[j : len(codes) - k + 1 + j])
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        first = np.r_[True, ordered[1:] != ordered[:-1]]
        starts = np.flatnonzero(first)
        numbers = np.empty(len(grams), dtype=np.uint64)
        numbers[order] = np.arange(len(grams)) - np.repeat(starts, np.diff(np.r_[starts, len(grams)]))
        return mixed(grams + numbers * MIX)

    def of(self, text: str) -> np.ndarray:
        """m tuple hashes."""
        grams = self.numbered(text)
        if not len(grams):
            return np.zeros(self.m, dtype=np.uint64)
        length = min(self.length, len(grams))
        rows = max(1, BLOCK // len(grams))
        return np.concatenate([self._tuples(grams, i, min(self.m, i + rows), length) for i in range(0, self.m, rows)])

    def _tuples(self, grams: np.ndarray, start: int, stop: int, length: int) -> np.ndarray:
        """The tuple hashes of hash functions start to stop: smallest values, in text order."""
        values = grams[None, :] * FACTORS[start:stop, None]
        each = np.arange(stop - start)
        chosen = np.empty((length, stop - start), dtype=np.int64)
        for j in range(length):
            chosen[j] = values.argmin(axis=1)
            values[each, chosen[j]] = LARGEST
        chosen.sort(axis=0)
        codes = FACTORS[start:stop].copy()
        for j in range(length):
            codes = mixed(codes * MIX + grams[chosen[j]])
        return codes


def shown(fingerprint: np.ndarray) -> str:
    """16 bits of each tuple hash as hexadecimal digits; an empty text has none."""
    return (fingerprint >> np.uint64(48)).astype(">u2").tobytes().hex() if fingerprint.any() else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The input with the column fingerprint (array of m longs)."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        maker = Fingerprints(**settings)
        return pd.Series([maker.of(t or "").view(np.int64) for t in texts])

    return docs.withColumn("fingerprint", run(F.col(text)))


def with_shards(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text and shard: ranges of doc_id of about ``rows`` rows each.

    Ranges start at doc_ids that exist; the row that starts a range also goes, marked ahead, to the range before,
    whose last row needs it.
    """
    chosen = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n, low, nulls = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, -(-n // rows))
    at = [i / parts for i in range(1, parts)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * parts)).alias("cuts")).first()[0] if at else []
    bounds = sorted({low, *(cuts or [])} - {None})
    bounds = [*([None] if nulls else []), *bounds]
    numbers = np.array([b for b in bounds if b is not None])
    shift = len(bounds) - len(numbers)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(numbers, ids.fillna(0).to_numpy(), side="right") - 1 + shift
        return pd.Series(np.where(ids.isna(), 0, found).astype("int32"))

    @F.pandas_udf("boolean")
    def starts(ids: pd.Series) -> pd.Series:
        return ids.isna() if shift and not len(numbers) else ids.isin(numbers) | (ids.isna() & bool(shift))

    last = len(bounds)
    own = F.struct(F.col("shard"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("shard") - 1, F.lit(max(1, last))).alias("shard"), F.lit(True).alias("ahead"))
    return (
        chosen.withColumn("shard", shard("doc_id"))
        .withColumn("to", F.explode(F.when(starts("doc_id"), F.array(own, before)).otherwise(F.array(own))))
        .select("doc_id", "text", "to.shard", "to.ahead")
    )


def with_next(docs: DataFrame, rows: int = ROWS, **settings) -> DataFrame:
    """Per row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    sharded = with_shards(docs, rows)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        maker = Fingerprints(**settings)
        frame = frame.sort_values(["ahead", "doc_id", "text"], na_position="first")
        here = int((~frame["ahead"]).sum())
        texts = frame["text"].tolist()[: here + 1]
        out = []
        own = [maker.of(t) for t in texts]
        for doc_id, text, following, mine, theirs in zip(frame["doc_id"][:here], texts, texts[1:], own, own[1:]):
            changed = edited(text, following)
            other = maker.of(changed)
            digest = hashlib.sha256(changed.encode()).hexdigest()
            near = likeness(mine, other), likeness(mine, theirs)
            out.append((doc_id, len(text), digest, shown(mine), shown(other), *near))
        return pd.DataFrame(out, columns=COLUMNS)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return sharded.groupBy("shard").applyInPandas(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
