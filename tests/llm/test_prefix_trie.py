import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from barloom.llm import prefix_trie as pt
from barloom.llm.queries import QUERIES

COLUMNS = "conv_id long, turn long, role string, text string, depth string, p1 string, length string, place string"


def plain(rows):
    """Brute force over (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        parent = members[node[:-1]][0] if node else None
        out.append((members[node][0], len(node), parent, len(members[node]), len(below), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame([(*row, "x", "x", "x", "x") for row in rows], COLUMNS)


def some_rows(seed, convs=300, ids=900):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(ids), convs):
        for turn in range(rng.randint(1, 9)):
            role, text = rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", "", None, "grün"])
            rows.append((c, turn, "system" if turn == 0 else role, "You help." if turn == 0 and c % 3 else text))
    return rows


@pytest.mark.parametrize("bound, messages", [(None, 200_000), (3, 4), (40, 1)])
def test_against_brute_force(make, bound, messages):
    rows = some_rows(bound or 0)
    assert found(pt.trie(make(rows), bound, messages)) == plain(rows)


def test_hard_rows(make):
    rows = some_rows(9, 60, 150)
    rows += [(None, 1, "user", "lost"), (3, None, None, None), (3, None, "a", "b"), (3, 2, "a", "b"), (3, 2, "a", "b"), (3, 2, "a", "a")]
    # Copies of one conversation, one given wholly by another, and one longer than a block.
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(200) for t in range(3)]
    rows += [(5000, t, "user", f"long {t % 7}") for t in range(2500)] + [(5001, t, "user", f"long {t % 7}") for t in range(2000)]
    rows += [(7, 4, "user", "word " * 50_000)]
    assert found(pt.trie(make(rows), 20)) == plain(rows)
    assert found(pt.trie(make(rows))) == plain(rows)


def test_turnless_conversations(make):
    taken = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1][:5]
    rows = [(c, 0, "user", "only turn") for c in taken]
    assert found(pt.trie(make(rows))) == plain(rows) and len(plain(rows)) == 1


def test_empty_table(make):
    assert pt.trie(make(some_rows(1)).limit(0)).count() == 0


def test_queue_spills():
    queue, rng = pt.SpillingQueue(10), random.Random(3)
    sent = [(rng.randint(1, 5), rng.randint(-9, 9), rng.randint(-2, 2), rng.randint(1, 9), rng.randint(0, 99)) for _ in range(500)]
    for message in sent:
        queue.push(*message)
    assert queue.spilled > 40 and len(queue.near) <= 10
    for key in sorted({m[:3] for m in sent}, key=lambda k: (-k[0], k[1], k[2])):
        assert sorted(queue.take(*key)) == sorted(m[3:] for m in sent if m[:3] == key)


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, folder)) == plain(rows)
