import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from barloom.llm import token_counts as tc
from barloom.llm.queries import QUERIES


def plain(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tc.MODEL))
    return [len(ids) for ids in model.encode(texts)]


def test_hard_rows(make_docs, hard):
    out = tc.token_counts(make_docs(hard))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = [text or "" for _, text in hard]
    want = [(k, len(t.encode()), n, n > 4096) for (k, _), t, n in zip(hard, texts, plain(texts))]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert any(row[3] for row in want)


@pytest.mark.parametrize("entries", [0, 3, tc.TABLE])
def test_odd_texts(make_docs, entries):
    parts = ["a", "the", "in", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", ".", "23", "é", "漢", tc.SPACE, "<s>", "</s>", "\x00", "🙂", "\xa0"]
    random.seed(5)
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(3000)] + ["", " ", "\n", tc.SPACE, "x" * 50_000]
    out = tc.token_counts(make_docs(list(enumerate(texts))), entries=entries)
    assert {r.doc_id: r.n_tokens for r in out.collect()} == dict(enumerate(plain(texts)))


def test_small_summaries_and_caches_do_not_change_counts(make_docs, monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 5)
    counter = tc.PieceCounter(public_tokenizers.path(tc.MODEL))
    units = [f"{tc.SPACE}word{i % 40}" for i in range(200)] + [tc.SPACE + "long" * 40]
    assert counter.lengths(units) == counter.encoded(units)
    assert len(counter.known) <= len(set(units))


def test_model_without_cuts_counts_whole_texts(make_docs, monkeypatch):
    monkeypatch.setattr(tc.counter(public_tokenizers.path(tc.MODEL)), "cuts", False)
    texts = ["some words here\n and there", ""]
    assert [r.n_tokens for r in tc.token_counts(make_docs(list(enumerate(texts)))).orderBy("doc_id").collect()] == plain(texts)


def test_pretokens():
    units = tc.pretokens(pa.array(["a b  c\nd", ""], pa.large_string())).to_pylist()
    assert [[u for u in us if u] for us in units] == [["▁a", "▁b", "▁▁c", "d"], ["▁"]]


def test_empty_table(make_docs, spark):
    assert tc.token_counts(make_docs([(1, "x")]).limit(0)).count() == 0


def test_query(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = dict(zip(texts, plain(list(texts.values()))))
    assert {r.doc_id: r.n_tokens for r in QUERIES["op13_token_counts"](spark, folder).collect()} == want
