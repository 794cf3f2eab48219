import pytest

from barloom.llm.workers import reachable

EXTRA = ["size", "score", "shard", "label", "n", "key", "copy", "begin", "line", "leaf", "component"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


@pytest.fixture(autouse=True)
def workers(spark):
    reachable(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source), with columns of names the operators use."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text, source = (*row, "s")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text), *(["x"] * len(EXTRA))))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def hard():
    """Rows with nulls, empty and very long texts, ties and repeats."""
    long = " ".join(f"w{i % 4001} x{i % 13}" for i in range(30_000))
    same = " ".join(f"t{i}" for i in range(120))
    return [
        (1, same), (2, same), (2, same), (3, same + " end"), (4, None), (5, ""), (6, " \t\n "), (None, same), (None, None),
        (7, long), (8, long + " more"), (9, "one"), (10, "one"), (11, "ab " * 300), (12, "ab " * 300), (7, "other text of seven"),
    ]
