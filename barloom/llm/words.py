"""Words of many texts at once, as codes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose words are held at a time, unless one text has more.
CHUNK_CHARS = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """[start, stop) of runs of texts of bounded length."""
    start = 0
    while start < len(texts):
        stop, n = start, 0
        while stop < len(texts) and (stop == start or n + len(texts[stop]) <= chars):
            n += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop


def coded_words(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words [^\\x20\\x09-\\x0D]+ of the texts: word codes, where each text starts (one more than texts), vocabulary."""
    column = pa.array(texts, pa.large_string())
    if lower:
        column = pc.ascii_lower(column)
    lists = pc.ascii_split_whitespace(column)
    words = lists.values
    filled = pc.not_equal(words, "")
    sums = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    starts = sums[lists.offsets.to_numpy()]
    coded = words.filter(filled).dictionary_encode()
    return coded.indices.to_numpy(), starts, coded.dictionary.to_pylist()


def word_hashes(vocabulary: list[str], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode(), seed) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))
