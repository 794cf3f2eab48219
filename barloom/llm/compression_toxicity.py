"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary texts, one on the same plus the words that set toxic
texts apart. A window (a word, lower-cased, without marks at its ends) is compressed with both; it stands between two
fixed carriers that both dictionaries hold, so that every window becomes one compressed block and the lengths
differ only by what the dictionaries know of the window. The difference of the two lengths, in bytes, is
the window's excess. A document's score is a logistic function of how many of its windows reach each excess,
calibrated on training documents that the dictionaries of the calibration had not seen.

Defined results: a null text counts as empty; texts without words score as calibrated for no excess;
without training rows of both kinds every score is the share of toxic ones (0 without rows); null labels and labels of
absent documents teach nothing; conflicting labels of one doc_id count by their largest; repeated rows give repeated
rows; a null doc_id is not held out and never learnt from; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training rows taken at most, toxic and ordinary.
TOXIC_ROWS, ORDINARY_ROWS = 2000, 5000
LEVEL = 10
ORDINARY_BYTES = 1 << 16
TOXIC_BYTES = 1 << 15
#: A word sets toxic texts apart from this log-odds and log-likelihood ratio of its document counts on.
LEAST_ODDS, LEAST_RATIO = 2.0, 14.0
EXCESSES = (2, 3, 4, 5, 6, 7)
CARRIERS = bytes(range(128, 192)), bytes(range(192, 256))
ENDS = re.compile(rb"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$")
MARKS = bytes(b for b in range(33, 128) if not chr(b).isalnum())


def windows(text: str) -> list[bytes]:
    return [w for w in (x.strip(MARKS) for x in text.lower().encode("utf-8", "replace").split()) if w]


class Dictionaries:
    """A pair of compressors; excess() keeps what it has measured, up to a number of windows."""

    def __init__(self, ordinary: bytes, toxic: bytes, entries: int = 250_000):
        self.content, self.entries = (ordinary, toxic), entries
        self.known: dict[bytes, int] = {}
        self.pair = None

    def __reduce__(self):
        return Dictionaries, (*self.content, self.entries)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def _lengths(self, side: int, blocks: list[bytes]) -> np.ndarray:
        found = self.pair[side].multi_compress_to_buffer(blocks, threads=1)
        return np.fromiter((len(found[i]) for i in range(len(found))), dtype=np.int64, count=len(blocks))

    def measure(self, new: list[bytes]) -> None:
        ordinary, toxic = self.content
        front, back = CARRIERS
        if self.pair is None:
            shared = ordinary + front + b"\x00" * 16 + back
            # The shared part comes last in both: distances to it are the same.
            self.pair = self._compressor(shared), self._compressor(toxic + shared)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            blocks = [front + b" " + w + b" " + back for w in part]
            self.known.update(zip(part, (self._lengths(0, blocks) - self._lengths(1, blocks)).tolist()))

    def excess(self, words: list[bytes]) -> list[int]:
        if len(self.known) > self.entries:
            self.known.clear()
        if new := list(set(words).difference(self.known)):
            self.measure(new)
        known = self.known
        return [known[w] for w in words]

    @classmethod
    def trained(cls, toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Dictionaries:
        in_toxic, in_ordinary = Counter(), Counter()
        for words in toxic:
            in_toxic.update(set(words))
        # A word of one text sets nothing apart.
        several = {w for w, n in in_toxic.items() if n > 1}
        for words in ordinary:
            in_ordinary.update(several.intersection(words))

        def odds(w):
            return math.log((in_toxic[w] + 0.5) / (len(toxic) + 1)) - math.log((in_ordinary[w] + 0.5) / (len(ordinary) + 1))

        def ratio(w):
            """How much likelier the two counts are with a rate each than with a common one."""
            a, b, rate = in_toxic[w], in_ordinary[w], len(toxic) / (len(toxic) + len(ordinary))
            return 2 * (a * math.log(a / ((a + b) * rate)) + (b * math.log(b / ((a + b) * (1 - rate))) if b else 0.0))

        apart = [w for w in several if odds(w) >= LEAST_ODDS and ratio(w) >= LEAST_RATIO]
        apart.sort(key=lambda w: (in_toxic[w] * odds(w), w))
        draw, total = random.Random(5), sum(map(len, ordinary))
        places = set(draw.sample(range(total), min(total, ORDINARY_BYTES // 4)))
        each = itertools.chain.from_iterable(ordinary)
        plain = [w for i, w in enumerate(each) if i in places]
        draw.shuffle(plain)
        return cls(b" ".join(plain)[:ORDINARY_BYTES], b" ".join([b"", *apart, b""])[-TOXIC_BYTES:])


def features(excess: list[int]) -> list[float]:
    found = np.array(excess, dtype=np.int64)
    counts = [int((found >= x).sum()) for x in EXCESSES]
    per = 100 / max(20, len(excess))
    return [1.0, *(math.log1p(c) for c in counts), *(math.log1p(c * per) for c in counts), math.log1p(len(excess)) / 5]


class Model:
    def __init__(self, dictionaries: Dictionaries | None, weights: np.ndarray):
        self.dictionaries, self.weights = dictionaries, weights

    def release(self) -> None:
        """Forget the windows measured so far: the worker lives on after its task."""
        if self.dictionaries is not None:
            self.dictionaries.known.clear()

    def score(self, text: str) -> float:
        if self.dictionaries is None:
            return float(self.weights[0])
        x = features(self.dictionaries.excess(windows(text)))
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(x, self.weights)))))))

    @classmethod
    def trained(cls, texts: list[str], labels: list[int]) -> Model:
        if len(set(labels)) < 2:
            return cls(None, np.array([float(labels[0]) if labels else 0.0]))
        # Equal words are one object: the training texts together have few.
        pool: dict[bytes, bytes] = {}
        words = [[pool.setdefault(w, w) for w in windows(t)] for t in texts]
        del pool

        def dictionaries(rows):
            return Dictionaries.trained([words[i] for i in rows if labels[i]], [words[i] for i in rows if not labels[i]])

        seen, unseen = [], []
        halves = [[i for i in range(len(texts)) if zlib.crc32(texts[i].encode()) % 2 == h] for h in (0, 1)]
        for learnt, judged in (halves, halves[::-1]):
            if {labels[i] for i in learnt} == {0, 1}:
                pair = dictionaries(learnt)
                unseen += [features(pair.excess(words[i])) for i in judged]
                seen += [labels[i] for i in judged]
                del pair
        whole = dictionaries(range(len(texts)))
        if set(seen) != {0, 1}:
            unseen, seen = [features(whole.excess(w)) for w in words], labels
        whole.known.clear()
        return cls(whole, logistic(np.array(unseen), np.array(seen, dtype=float)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """A model from labelled documents that are not held out; at most that many rows, chosen by a hash of doc_id.

    The ids are chosen first, over the narrow labels; only the chosen documents' texts come to the driver.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~is_held_out()).join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id")
    ordered = known.withColumn("order", F.xxhash64("doc_id"))
    chosen = ordered.where("toxic = 1").orderBy("order", "doc_id").limit(toxic_rows)
    chosen = chosen.union(ordered.where("toxic = 0").orderBy("order", "doc_id").limit(ordinary_rows)).select("doc_id", "toxic")
    # At most toxic_rows + ordinary_rows ids: small enough to send to every task.
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = sorted(texts.collect())
    return Model.trained([r["text"] for r in rows], [r["toxic"] for r in rows])


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The input with the score, 0 to 1, in the column ``name`` (a column of that name is replaced)."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")
        model.release()

    return docs.withColumn(name, run(F.coalesce(F.col(text), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, **rows) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scored(docs.select("doc_id", "text"), learn(docs, labels, **rows))
    return out.select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
