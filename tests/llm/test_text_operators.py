"""Operators on texts against brute force, and what they return for hard input."""

import base64
import hashlib
import random
import re

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import byte_bpe, licence_rules, line_templates, order_minhash, repeated_passages, setsketch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def prose(seed, n):
    rng = random.Random(seed)
    return [rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randrange(60)) for _ in range(n)]


def copied(seed=1):
    """Texts that share passages of all lengths, and near copies."""
    rng, out = random.Random(seed), []
    for i in range(60):
        words = prose(1000 + i, rng.randrange(0, 200))
        if i % 2 and out:
            other = rng.choice(out).split()
            start = rng.randrange(max(1, len(other)))
            cut = other[start : start + rng.randrange(30, 90)]
            words[rng.randrange(len(words) + 1) : 0] = cut
        if i % 5 == 4:
            words = rng.choice(out).split()
            for _ in range(rng.randrange(4)):
                if words:
                    words[rng.randrange(len(words))] = "edit"
        out.append(" ".join(words))
    return out


# Substring dedup


def brute_passages(pairs, window=50):
    first = {}
    for doc_id, text in pairs:
        words = WORDS.findall(text or "")
        if doc_id is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in pairs:
        words = WORDS.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1) if doc_id is not None else ():
            if first[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_passages(make_docs, hard):
    pairs = hard + [(100 + i, t) for i, t in enumerate(copied())]
    assert rows(repeated_passages.digests(make_docs(pairs))) == brute_passages(pairs)
    assert rows(repeated_passages.digests(make_docs([]))) == []


def test_passages_of_other_windows(make_docs):
    pairs = [(i, t) for i, t in enumerate(copied(7))]
    assert rows(repeated_passages.digests(make_docs(pairs), window=20)) == brute_passages(pairs, 20)


# MinHash near-dedup


def brute_near(pairs, size):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in pairs:
        words = WORDS.findall((text or "").translate(table))
        found = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets.append(found if len(words) >= size else {tuple(words)} if words else set())
    label = {d: d for d, _ in pairs if d is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (d, _), a in zip(pairs, sets):
        for (e, _), b in zip(pairs, sets):
            if None not in (d, e) and d < e and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(d), find(e)))
                label[high] = low
    out = []
    for (d, _), a in zip(pairs, sets):
        component = None if d is None else find(d)
        out.append((d, len(a), component, d is None or d == component))
    return sorted(out, key=repr)


def test_near_duplicates(make_docs, hard):
    pairs = hard + [(100 + i, t) for i, t in enumerate(copied())] + [(200, "A b C"), (201, "a B c")]
    for size in (2, 5):
        assert rows(setsketch.near_duplicates(make_docs(pairs), size)) == brute_near(pairs, size)
    assert rows(setsketch.near_duplicates(make_docs([]))) == []


def test_chains_and_crowded_buckets(make_docs):
    """Every text differs from the next by a little: neighbours link, ends do not."""
    base, pairs = prose(5, 100), []
    for i in range(40):
        words = base[:]
        words[: 2 * i] = [f"z{j}" for j in range(2 * i)]
        pairs.append((40 - i, " ".join(words)))
    assert rows(setsketch.near_duplicates(make_docs(pairs), 2)) == brute_near(pairs, 2)


def test_one_of_each_keeps_columns_and_rows(make_docs, hard):
    docs = make_docs(hard)
    kept = setsketch.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"]) == [1, 4, 5, 6, 7, 7, 9, 11]


def test_sketches_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = pool[:700], pool[100:]
    one, two = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.registers(pool) == np.maximum(one, two)).all()
    near = setsketch.similarities(one[None], two[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(near - 600 / 900) < 0.2


# Order MinHash


def test_order_minhash_follows_the_ring(make_docs, hard):
    pairs = hard[:6] + [(20, "last of all")]
    got = {(r["doc_id"], r["n_chars"]): r for r in order_minhash.with_next(make_docs(pairs), rows=2).collect()}
    ring = sorted(pairs, key=lambda p: p[0])
    for (doc_id, text), (_, after) in zip(ring, ring[1:] + ring[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        row = got[doc_id, len(text)]
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert len(got) == len(set((d, len(t or "")) for d, t in pairs))
    assert got[1, len(hard[0][1])]["near_next"] == 1.0
    assert order_minhash.with_next(make_docs([])).collect() == []
    nulls = order_minhash.with_next(make_docs([(None, None), (None, "a")])).collect()
    assert sorted(r["n_chars"] for r in nulls) == [0, 1]


def test_order_minhash_sees_order_and_repeats():
    maker = order_minhash.Fingerprints()
    words = prose(2, 300)
    near = lambda a, b: order_minhash.likeness(maker.of(" ".join(a)), maker.of(" ".join(b)))
    few = words[:]
    few[50] = few[200] = "edit"
    assert near(words, words) == 1
    assert near(words, few) > near(words, words[150:] + words[:150]) > near(words, prose(3, 300))
    assert near(words, words * 2) < 0.6


# Byte-level BPE


def reference():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODING = reference()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdé1")), max_size=60))
def test_ids_are_the_library_s(text):
    encoder = byte_bpe.unit_encoder(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    ids = next(encoder.ids([text]))
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == ENCODING.encode_ordinary(text)


def test_bpe_on_tables(make_docs, hard):
    got = rows(byte_bpe.digests(make_docs(hard)))
    want = []
    for doc_id, text in hard:
        ids = ENCODING.encode_ordinary(text or "")
        coded = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert rows(byte_bpe.digests(make_docs([]))) == []
    assert all(r["same"] for r in byte_bpe.tokenised(make_docs(hard)).collect())


def test_bpe_offsets_and_split_characters(make_docs):
    text = "naïve \U0001f9d1‍\U0001f680 日本 end"
    encoded = byte_bpe.encode(make_docs([(1, text)]))
    row = encoded.first()
    assert row["ids"] == ENCODING.encode_ordinary(text)
    assert all(a <= b <= len(text) for a, b in zip(row["starts"], row["ends"]))
    assert row["ends"][-1] == len(text)
    back = byte_bpe.decode(encoded).first()
    assert back["text"] == text and bytes(back["bytes"]) == text.encode()


# Large buckets of near copies


def test_setsketch_compares_few_in_large_buckets(make_docs, monkeypatch):
    """Members of large buckets that do not link are compared with a few of them before the prefix filter, not with sixteen."""
    rng, base, tried = random.Random(5), prose(3, 300), []
    pairs = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(300), 12):
            words[at] = f"own{i}x{at}"
        pairs.append((i, " ".join(words)))

    def counted(df, name, write=setsketch.materialise):
        out = write(df, name)
        if name == "pairs":
            tried.append(out.count())
        return out

    monkeypatch.setattr(setsketch, "materialise", counted)
    assert rows(setsketch.near_duplicates(make_docs(pairs), 2)) == brute_near(pairs, 2)
    assert tried[2] < 25 * len(pairs)


# Line templates


def test_line_templates(make_docs):
    pairs = [(i, f"{'abcdefghijklmnop'[i]} own line of a document\nUser {i} signed in at {i}:00 today\nGood by") for i in range(12)]
    pairs += [(20, None), (21, ""), (None, "User 5 signed in at 9:15 today")]
    out = {r["doc_id"]: r for r in line_templates.deduplicated(make_docs(pairs)).collect()}
    assert "signed in" in out[0]["text"] and out[0]["n_dropped"] == 0
    assert all("signed in" not in out[i]["text"] and out[i]["n_dropped"] == 1 for i in range(1, 12))
    assert all("Good by" in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"]) for i in range(12))
    assert out[20]["text"] is None and out[20]["n_lines"] == 0 and out[21]["text"] == "" and out[21]["n_lines"] == 1
    assert out[None]["text"] == "" and out[1]["size"] == "x"
    assert rows(line_templates.digests(make_docs([]))) == []


def test_line_templates_generalise_words(make_docs):
    names = ["ann", "bob", "cyd"]
    pairs = [(i, f"please log in again before noon today dear {names[i % 3]} {i} thanks") for i in range(12)]
    lines = line_templates.leaves(make_docs(pairs + [(20, "please log in again before noon today dear")]))
    assert [r["first"] for r in line_templates.recurring(lines, 12).collect()] == [0]
    assert line_templates.recurring(lines, 13).collect() == []


def test_line_templates_compare_all_tokens(make_docs):
    """Lines that only begin alike, and rows of figures, are no template."""
    begin = "this page of the site is about the"
    ends = "abbey bridge castle dome estuary forest garden harbour island jetty kiosk lighthouse".split()
    pairs = [(i, f"{begin} {w}\n{begin} {w} and its long {w} story\n{i} {i + 5} {i * 7}\n| {i} | {i + 1} |\n1 2 3 4 5 6 7 8 9 {i} {w}") for i, w in enumerate(ends)]
    out = line_templates.deduplicated(make_docs(pairs)).collect()
    assert all(r["n_dropped"] == 0 and r["text"] == dict(pairs)[r["doc_id"]] for r in out)
    same = [(i, f"own {w}\n{begin} old town and its story") for i, w in enumerate(ends)]
    assert sorted(r["n_dropped"] for r in line_templates.deduplicated(make_docs(same)).collect()) == [0] + [1] * 11


def test_line_templates_hash_a_line_once(make_docs):
    """Joins by the leaf hash no line again, and texts are joined in the same way at every size."""
    docs = make_docs([(i, f"own\tline of a {i}\x0b\nanother \f line here") for i in range(12)])
    lines = line_templates.leaves(docs)
    held = lines.join(lines.select("leaf").distinct(), "leaf")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"isnotnull\((coalesce\()?unhex", held) and "translate" not in held
    assert {r["line"] for r in lines.collect()} == {f"own line of a {i}" for i in range(12)} | {"another   line here"}
    plan = line_templates.deduplicated(docs)._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[doc.*copy.*LeftOuter", plan)


# Licences


def test_licences(make_docs, hard):
    s = licence_rules.SENTENCES
    mit = f"Copyright me.\n{s['mit-grant']}\n\n{s['mit-notice']}\nSomething between.\n{s['as-is']}"
    wrapped = re.sub(r"(.{40}\S*) ", r"\1\n", s["isc-grant"])
    pairs = [
        (50, mit), (51, "\n".join(reversed(mit.split("\n")))), (52, f"Text\n\n{wrapped}\n\nmore"),
        (53, "Words. Licensed under CC BY-NC 4.0. Words"), (54, "licensed under nothing"),
        (55, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved."),
    ]
    out = {r["doc_id"]: r["licences"] for r in licence_rules.scan(make_docs(pairs + hard)).collect()}
    assert out[50] == "MIT" and out[51] == "" and out[52] == "ISC" and out[53] == "CC-BY-NC-4.0" and out[54] == ""
    assert out[55] == "GPL-3.0" and out[4] == "" and out[5] == ""
    assert rows(licence_rules.scan(make_docs([]))) == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""


def test_licence_headers(make_docs):
    other = APACHE.split("\n", 1)[1]
    wrapped = APACHE.replace("you may not use this file\n", "").replace('"License");\nyou may', '"License"); you may\n')
    commented = ["\n".join(mark + line for line in text.split("\n")) for text in (APACHE, other, wrapped) for mark in ("", "# ", " * ", "// ")]
    pairs = [(i, f"Copyright 2020 me\n\n{text}\n\nimport os") for i, text in enumerate(commented)]
    pairs += [
        (50, "# SPDX-License-Identifier: MIT\nimport os"), (51, "// SPDX-License-Identifier: GPL-2.0-only"), (52, "SPDX-License-Identifier:ISC"),
        (53, "SPDX-License-Identifier: MIT OR Apache-2.0"), (54, "Title\nMIT\nSPDX-License-Identifier: other"),
        (55, "## License\n\nThis project is licensed under the MIT License - see the LICENSE file for details."),
        (56, "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details"),
    ]
    out = {r["doc_id"]: r["licences"] for r in licence_rules.scan(make_docs(pairs)).collect()}
    assert [out[i] for i in range(len(commented))] == ["Apache-2.0"] * len(commented)
    assert out[50] == out[55] == out[56] == "MIT" and out[51] == "GPL-2.0" and out[52] == "ISC"
    assert out[53] == "Apache-2.0 AND MIT" and out[54] == ""


# Texts as the licences have them, with the usual numbering.
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def test_licences_in_full(make_docs):
    head = "Copyright (c) 2020, Some One. All rights reserved.\n\n"
    texts = [
        (head + BSD_3, "BSD-3-Clause"), (head + BSD_2, "BSD-2-Clause"), (head + MIT, "MIT"), (head + "Words.", "Proprietary"), ("Words.", ""),
        (BSD_2 + "\nThe other part:\n\n" + BSD_3, "BSD-2-Clause AND BSD-3-Clause"), (BSD_3 + "\n\nand\n\n" + BSD_2, "BSD-2-Clause AND BSD-3-Clause"),
        (BSD_3 + "\n\n" + BSD_3, "BSD-3-Clause"), (BSD_3 + "\n\n" + MIT, "BSD-3-Clause AND MIT"),
        (BSD_2.split("2. ")[0], ""), ("This file is licensed under the MIT License.\n" + MIT, "MIT"),
    ]
    out = {r["doc_id"]: r for r in licence_rules.scan(make_docs([(i, t) for i, (t, _) in enumerate(texts)])).collect()}
    assert [out[i]["licences"] for i in range(len(texts))] == [want for _, want in texts]
    # Wrapped sentences are shown, too.
    assert out[2]["sentence_ids"] == "reserved>mit-grant>mit-notice>as-is" and out[2]["n_known"] == 4
