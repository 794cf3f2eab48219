"""Embeddings, pages, toxicity, mixing and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import compression_toxicity, html_text, projection_trees, source_mix

VECTORS = "vec_id long, embedding array<float>, label int, leaf string, copies string, size string, tree string"


def make_vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)


def brute_vectors(rows, threshold=0.98):
    unit = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = np.array(v, dtype=np.float32).astype(float)
            unit.setdefault(i, (v / np.linalg.norm(v), label))
    links, low = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, (a, la) in unit.items():
        for j, (b, lb) in unit.items():
            if i < j and la == lb and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                low[y] = x
    return {i: (links[i], None if i is None else find(i)) for i in links}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            centre = rng.standard_normal(24)
            for _ in range(int(rng.integers(1, 30))):
                rows.append((k, (centre + rng.standard_normal(24) * rng.choice([0, 0.02, 0.1, 0.14])).tolist(), label))
                k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 24, 1), (k + 2, [float("nan")] + [1.0] * 23, 1), (k + 3, [1.0, None] + [1.0] * 22, 1)]
    rows += [(k + 4, rows[0][1], None), (None, rows[0][1], 0), (k + 5, [], 1), (k + 6, [1.0, 2.0], 1), (k + 7, [2.0, 4.0], 1)]
    rows += [(k + 8, [float("inf")] * 24, 1), (5, rows[5][1], rows[5][2]), (k + 9, [1e-30] * 24, 2), (k + 10, [3e30] * 24, 2)]
    out = projection_trees.near_duplicates(make_vectors(spark, rows)).collect()
    assert len(out) == len(rows)
    want = brute_vectors(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in out)
    assert projection_trees.near_duplicates(make_vectors(spark, [])).collect() == []


def test_routed_trees_find_all(spark, monkeypatch):
    """With upper splits fitted on the sample, pairs still meet."""
    monkeypatch.setattr(projection_trees, "ROUTED", 400)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((400, 64))
    rows = [(i, (centres[i % 400] + rng.standard_normal(64) * 0.1).tolist(), 0) for i in range(1600)]
    out = {r["vec_id"]: r["n_links"] for r in projection_trees.near_duplicates(make_vectors(spark, rows)).collect()}
    want = brute_vectors(rows)
    found, there = sum(out.values()), sum(n for n, _ in want.values())
    assert there > 1000 and found >= 0.99 * there and all(out[i] <= want[i][0] for i in out)


# Pages

ARTICLE = "<h1>Title &amp; more</h1><p>First  paragraph\nwith <b>bold</b> words and a <a href='/x'>link</a>.<p>Second one, a little longer than the first.<ul><li>Item one</li><li>Item two</ul>"
PAGE = f"""<!doctype html><html><head><title>Title</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/b>Other</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, please agree to that now.</p></div><aside>Side words here</aside>
<article>{ARTICLE}<div class="ad">Buy this now</div><form><label>Mail</label><input></form><p>Last paragraph after the advert.</p>
<section id="comments"><p>Reader says something long about the article and much else.</p></section></article>
<footer>&copy; 2024 the site and all its friends</footer></body></html>"""
TEXT = "Title & more\n\nFirst paragraph with bold words and a link.\n\nSecond one, a little longer than the first.\n\nItem one\n\nItem two\n\nLast paragraph after the advert."


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>Only"), (5, "u", "a < b <"), (1, "u", PAGE), (None, "u", PAGE)]
    rows += [(6, "u", "<div " * 20000), (7, "u", f"<main>{'word ' * 100000}</main>"), (8, "u", "<script>never closed <p>text")]
    rows += [(9, "u", PAGE.replace("article", "main"))]
    schema = "page_id long, url string, html string, text string, n_chars string, hash string"
    pages = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], schema)
    out = html_text.extract_pages(pages).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert got[1] == got[None] == got[9] == TEXT
    assert got[2] == got[3] == got[8] == "" and got[4] == "Only" and got[5] == "a < b <" and len(got[7].split()) == 100000
    assert html_text.extract_pages(spark.createDataFrame([], schema)).collect() == []


# Toxicity


def test_pages_in_wrappers_with_junk_names(spark):
    article = "<h1 class='section-header'>Title</h1><p>Words of the text that matter here.</p><div class='ad'>Buy this</div>"
    side = "<nav>Home Other</nav><div class='sidebar'>Side words</div>"
    whole = f"{side}<article>{article}</article>"
    related = "<div class='related'><article>Other story in short</article></div>"
    pages = [
        f"<body class='with-sidebar'>{whole}</body>",
        f"<html class='no-menu'><body>{side}<div id='content' class='no-sidebar'><article>{article}</article>{related}</div></body>",
        f"<body>{side}<div class='elementor-widget'><main class='has-comments'>{article}</main></div></body>",
        f"<body><form action='/'>{whole}</form></body>",
        f"<body>{whole}{related}</body>",
        "<body><nav>Home</nav><div class='no-sidebar'><h1>Title</h1><p>Words of the text that matter here.</p></div></body>",
    ]
    rows = [(i, "u", page) for i, page in enumerate(pages)]
    out = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == dict.fromkeys(range(len(rows)), "Title\n\nWords of the text that matter here.")
    assert html_text.page_counts(pages[0])["warticle", True] == 8



def test_toxicity_on_held_out_rows(spark, folder, make_docs):
    big = folder.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    out = compression_toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out")
    rows = [(r["toxic"], r["predicted"], r["score"], r["doc_id"]) for r in out.collect()]
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 and 0 <= s <= 1 and p == (s >= 0.5) for _, p, s, d in rows)
    hits = sum(t == p for t, p, _, _ in rows) / len(rows)
    caught = sum(p for t, p, _, _ in rows if t) / sum(t for t, _, _, _ in rows)
    assert hits > 0.97 and caught > 0.85


def test_toxicity_of_hard_input(spark, make_docs, hard):
    labels = spark.createDataFrame([(1, 0, 0), (9, 1, 1), (99, 1, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for told in (labels, labels.limit(0)):
        out = compression_toxicity.classify(make_docs(hard), told).collect()
        assert len(out) == len(hard) and all(0 <= r["score"] <= 1 for r in out)
        assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    assert compression_toxicity.classify(make_docs([]), labels).collect() == []


# Mixing


def water(sizes, weights):
    """Targets by sharing the excess again and again."""
    target, left = {}, dict(sizes)
    total = sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            del left[s]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(make_docs, seed):
    rng = random.Random(seed)
    pairs = [(i, "w " * rng.choice([0, 1, 5, 40, 500, 3000]), rng.choice(["a", "a", "a", "b", "cé", "d", None])) for i in range(200)]
    pairs += [(500, "small " * 70, "e"), (501, None, "f"), (None, "null id", "a"), (3, "again " * 50, "b"), (3, "again " * 50, "b")]
    out = source_mix.mixed(make_docs(pairs)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, source_mix.mixed(make_docs(pairs)).collect()), key=repr)
    sizes = {}
    for _, text, source in pairs:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    assert len(out) == len(pairs) and sorted({r["source_size"] for r in out}) == sorted(set(sizes.values()))
    by_size = {sizes[s]: want[s] for s in sizes}
    for r in out:
        assert r["target"] == pytest.approx(by_size[r["source_size"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for size, target in by_size.items():
        taken = sum(r["taken"] for r in out if r["source_size"] == size)
        assert abs(taken - target) <= 0.02 * target + 3 * source_mix.BLOCK
    assert source_mix.mixed(make_docs([])).collect() == []


def test_mix_texts_hold_the_words_taken(make_docs):
    pairs = [(i, " ".join(f"d{i}w{j}" for j in range(150 + 7 * i)), "ab"[i % 2]) for i in range(30)]
    docs = make_docs(pairs)
    taken = {r["doc_id"]: r["taken"] for r in source_mix.mixed(docs).collect()}
    out = source_mix.mix_texts(docs)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        words = r["text"].split(" ")
        assert set(words) <= set(pairs[r["doc_id"]][1].split()) and len(set(words)) == len(words) and r["size"] == "x"
        assert r["n_chars"] == len(r["text"])
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + len(words)
    assert found == {d: n for d, n in taken.items() if n}
    assert source_mix.mix_texts(make_docs([])).collect() == []


# Pipeline


def test_stages_keep_their_promises(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        rows = after.collect()
        if name == "byte-level BPE encoding and decoding":
            assert len(rows) == docs.count() and all(r["same"] for r in rows)
            break
        assert after.columns == columns
        before, ids = docs.count(), {r["doc_id"] for r in rows}
        if name == "line dedup":
            assert len(rows) == before
        elif name != "mixing sources to target weights":
            assert 0.5 * before < len(rows) <= before and len(ids) == len(rows)
        docs = spark.createDataFrame(rows, after.schema)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "same"] and out.where("not same").count() == 0 and out.count() > 50
