import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import phrase_stripes as ps

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, at_least, subsumed=100, top=2000):
    """Brute force over (text, lang)."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= at_least}
        most = Counter()
        for p, a in chosen.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        found = []
        for p, a in chosen.items():
            if p in most and 100 * most[p] >= subsumed * a:
                continue
            cuts = [(1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((" ".join(p), a, f[p[:k]], f[p[k:]], sizes[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return sorted(out)


def run(docs, **options):
    out = ps.collocations(docs, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(*row, "x", 7) for row in rows], "text string, lang string, prefix string, part int")


def some_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "time", "über", "ÜBER", "\xa0x", "a.b", "漢", "last\tweek", "x-y"]
    texts = []
    for _ in range(n):
        body = " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 60)))
        texts.append((body.replace("new york time", "New York Times, daily") + rng.choice([".", "!\n", "\r\n", "  "]), rng.choice(["en", "de", None])))
    return texts + [(None, "en"), ("", "fr"), (" \t ", None), texts[0], texts[0]]


@pytest.mark.parametrize("bits", [4, 24])
@pytest.mark.parametrize("at_least, subsumed, top", [(3, 100, 2000), (2, 80, 20), (300, 100, 5)])
def test_against_brute_force(make, bits, at_least, subsumed, top):
    rows = some_rows(at_least, 120 if at_least < 10 else 3000)
    want = plain(rows, at_least, subsumed, top)
    assert run(make(rows), at_least=at_least, subsumed=subsumed, top=top, bits=bits) == want
    assert want


def test_very_long_text_and_hot_words(make):
    rows = [("the of " * 60_000 + "end", "en"), ("the " * 500, "en")] + [("one common line here", None)] * 400
    assert run(make(rows), at_least=100) == plain(rows, 100)


def test_hard_documents(make_docs, hard):
    assert run(make_docs(hard), at_least=2) == plain([(text, "en") for _, text in hard], 2)


def test_empty_table(make):
    assert run(make(some_rows(1)).limit(0)) == [] == run(make([(None, "en")]))


def test_runs_are_counted_over_all_tasks(make, spark):
    docs = ps.prepared(make([("a b x", "en"), ("c d e", "en")] * 30 + [("c d e", "en")] * 70).repartition(7))
    pairs, words = ps.frequent_buckets(docs, 100, 16)
    assert words.sum() == 390 and words.max() == 100
    found = ps.coded_pieces(["c d e"])
    assert np.unpackbits(pairs).sum() == 2 and np.unpackbits(pairs)[ps.counted_buckets("en", *found, 16, None)].all()
    longer, _ = ps.frequent_buckets(docs, 100, 16, spark.sparkContext.broadcast(pairs))
    assert np.unpackbits(longer).sum() == 1 and np.unpackbits(longer)[ps.counted_buckets("en", *found, 16, pairs)].all()
    marks = ps.extensions("en", *ps.coded_pieces(["c d e", "a b x"]), 16, pairs, longer)
    assert [list(np.flatnonzero(m)) for m in marks] == [[0, 1], [0], [], []]


def test_stripes_merge_elementwise(spark):
    rows = [("en", 1, 5, ["the", "the", "a"], ["cat", "dog", "cat"], [2, 1, 1]), ("en", 1, 5, ["the", "the"], ["dog", "owl"], [4, 1]), ("en", 1, 6, ["the"], ["x"], [2])]
    words = spark.sparkContext.broadcast(np.zeros(1 << ps.WORD_BITS, dtype=np.int64))
    out = {(r["shard"], r.prefix): r for r in ps.merge_stripes(spark.createDataFrame(rows, ps.STRIPES), 2, words).collect()}
    the = out[5, "the"]
    assert dict(zip(the["next"], the["n"])) == {"cat": 2, "dog": 5} and the.total == 8 and len(out) == 3
    assert out[5, "a"]["next"] == [] and out[5, "a"].total == 1
    assert {(r.up_prefix, r.up_next) for r in out.values()} == {("", "the"), ("", "a")}


def test_hot_stripes_are_dealt_into_parts(make, monkeypatch):
    monkeypatch.setattr(ps, "PART", 8)
    monkeypatch.setattr(ps, "SHARD", 100)
    rows = some_rows(7)
    assert run(make(rows), at_least=3) == plain(rows, 3)
    counts = np.zeros(1 << ps.WORD_BITS, dtype=np.int64)
    ps.add_words(counts, "en", *ps.coded_pieces(["the cat the dog " * 30]))
    assert ps.Parts(counts).of("en", ["", "the", "the cat", "owl"]).tolist() == [16, 8, 4, 1]


def test_windows():
    codes, words = ps.coded_pieces(["a b a b. c"])
    extended = [np.isin(np.arange(len(codes)), at) for at in ([0, 1, 2], [0, 1], [0], [])]
    got = {(r["prefix"], r["next"]): r["n"] for r in ps.windows(codes, words, extended).to_pylist()}
    assert got == {("a b a", "b"): 1, ("b a", "b"): 1, ("a", "b"): 1, ("", "b"): 1, ("", "c"): 1}
    assert isinstance(words, pa.Array)


def test_prefixes_are_python_strings_in_part(monkeypatch):
    """The memory of a task's Python strings stays that of a part of its entries."""
    counts = np.zeros(1 << ps.WORD_BITS, dtype=np.int64)
    prefixes, nexts = pa.array([f"prefix {i}" for i in range(200_000)]), pa.array(["a", "b"] * 100_000)
    deal = ps.Parts(counts)
    monkeypatch.setattr(ps, "ENTRIES", 1 << 20)
    want = deal.shard("en", prefixes, nexts)
    monkeypatch.setattr(ps, "ENTRIES", 10_000)
    tracemalloc.start()
    got = deal.shard("en", prefixes, nexts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and got.dtype == np.int32 and most < 8 << 20
    assert len(deal.shard("en", prefixes[:0], nexts[:0])) == 0


def test_merged_rows_in_parts(spark):
    """A shard of more prefixes than are taken at a time has each once, with its own entries."""
    n = ps.ENTRIES + 100
    words = spark.sparkContext.broadcast(np.zeros(1 << ps.WORD_BITS, dtype=np.int64))
    rows = [("en", 1, 5, [f"p{i}" for i in range(n)] * 2, ["x"] * n + ["y"] * n, [1] * n + list(range(n)))]
    out = ps.merge_stripes(spark.createDataFrame(rows, ps.STRIPES), 2, words).toPandas()
    assert len(out) == n and out.prefix.is_unique
    number = out.prefix.str[1:].astype(int)
    assert (out.total == number + 1).all() and (out.up_next == out.prefix).all()
    assert all(list(c) == (["y"] if i >= 2 else []) for i, c in zip(number, out.next))
    assert all(list(c) == ([i] if i >= 2 else []) for i, c in zip(number, out.n))
