"""Stored upserts leave partitions without batch rows alone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import merge
from barloom.sources import partitioned as pt

D = dt.date


@pytest.fixture()
def table(spark, tmp_path):
    bars = spark.createDataFrame([(t, D(2023, m, d), 1.0 * d) for t in "AB" for m in (1, 2, 3) for d in (3, 4)], "ticker string, date date, close double")
    pt.write_partitioned(bars, str(tmp_path / "bars"), pt.by_month())
    return tmp_path / "bars", bars


def files(path):
    return {f"{p.parent.name}/{p.name}" for p in path.rglob("*.parquet")}


def upserted(spark, path, rows):
    new = spark.createDataFrame(rows, "ticker string, date date, close double")
    return pt.upsert_stored(spark, str(path), new, pt.by_month(), lambda o, n: merge.upsert_bars(o, n, ["close"]))


def test_only_touched_partitions_are_rewritten(spark, table):
    path, bars = table
    before = files(path)
    assert upserted(spark, path, [("A", D(2023, 2, 3), 70.0), ("A", D(2023, 2, 3), 90.0), ("C", D(2023, 4, 1), 5.0)]) == ["2023-02", "2023-04"]
    kept = {f for f in before if not f.startswith("part=2023-02")}
    assert kept <= files(path) and not {f for f in before if f.startswith("part=2023-02")} & files(path)
    got = {(r.ticker, r.date): r.close for r in pt.read_partitioned(spark, str(path)).collect()}
    want = {(r.ticker, r.date): r.close for r in bars.collect()} | {("A", D(2023, 2, 3)): 70.0, ("C", D(2023, 4, 1)): 5.0}
    assert got == want


def test_empty_batch_and_failing_merge_leave_the_table(spark, table):
    path, _ = table
    before = files(path)
    assert upserted(spark, path, []) == [] and files(path) == before

    def fails(o, n):
        return o.withColumn("close", F.raise_error(F.lit("no")).cast("double"))

    with pytest.raises(Exception, match="no"):
        pt.upsert_stored(spark, str(path), spark.createDataFrame([("A", D(2023, 1, 3), 1.0)], "ticker string, date date, close double"), pt.by_month(), fails)
    assert files(path) == before


def test_only_touched_partitions_are_read(spark, table):
    path, _ = table
    plan = pt._stored(spark, str(path)).where(F.col("part").isin(["2023-02"]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan


ARTICLE = ("polygon_id string, title string, description string, article_url string, author string, published_at timestamp, publisher_name string, "
           "keywords array<string>, quality_score double, relevance_score double, tickers array<string>, insights array<string>")


def article(i, title, month, tickers=(), body="text"):
    return (i, title, body, "u", "a", dt.datetime(2024, month, 5), "p", ["k"], 0.5, 0.5, list(tickers), [])


def test_articles(spark, tmp_path):
    path = tmp_path / "articles"
    pt.write_articles(spark.createDataFrame([article("1", "one", 1, ["X"]), article("2", "two", 2), article("3", "three", 3)], ARTICLE), str(path))
    before = files(path)
    batch = [article("1", "one", 1), article("2", "TWO", 6), article("4", "four", 4, ["y"])]
    out = pt.upsert_stored_articles(spark, str(path), spark.createDataFrame(batch, ARTICLE))
    assert {r.polygon_id: r.outcome for r in out.collect()} == {"1": "skipped", "2": "updated", "4": "new"}
    rows = {r.polygon_id: r for r in pt.read_partitioned(spark, str(path)).collect()}
    assert rows["2"].title == "TWO" and rows["2"].published_at.month == 2 and rows["4"].tickers == ["Y"] and rows["1"].tickers == ["X"] and len(rows) == 4
    # January and March are as they were.
    assert {f for f in before if not f.startswith("part=2024-02")} <= files(path)
    again = pt.upsert_stored_articles(spark, str(path), spark.createDataFrame([article("2", "TWO", 6)], ARTICLE))
    assert again.collect()[0].outcome == "skipped"


def test_outcomes_read_no_bodies(spark, tmp_path):
    path = str(tmp_path / "articles")
    pt.write_articles(spark.createDataFrame([article("1", "one", 1)], ARTICLE), path)
    plan = pt.article_outcomes(spark, path, spark.createDataFrame([article("1", "one", 1)], ARTICLE)).select("outcome")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "ReadSchema: struct<polygon_id:string,digest:string>" in scan
