"""Inputs that are read several times are written once; quality needs no arrays of a ticker's values."""

import contextlib
import io
import pathlib

import pytest

from barloom.functions.shared import shared_folder
from barloom.operators import prepare, validate
from barloom.plans import panel, stored  # noqa: F401
from barloom.plans.common import QUERIES


def test_clean_numeric_reads_what_it_has_written(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), ("b", float("inf"))], "ticker string, x double")
    out = prepare.clean_numeric(df, ["x"], to_float=False)
    assert out.inputFiles() and sorted(r.x for r in out.collect()) == [1.0, 2.0, 2.0, 3.0]


def test_overall_quality_by_windows(spark):
    rows = [("a", float(i % 4), None) for i in range(19)] + [("a", 100.0, 1.0), ("b", 1.0, None), ("b", 900.0, 2.0), (None, 1.0, 1.0)]
    out = validate.overall_quality(spark.createDataFrame(rows, "ticker string, x double, y double"), ["x", "y"])
    with contextlib.redirect_stdout(text := io.StringIO()):
        out.explain()
    assert "collect_list" not in text.getvalue() and "ObjectHashAggregate" not in text.getvalue()
    got = {r.ticker: r.quality_score for r in out.collect()}
    # a: 21 of 40 values, one outlier among the 20 of x; the columns of b and null are too short to be tested.
    assert got == pytest.approx({"a": 100 * 21 / 40 * 0.95, "b": 75.0, None: 100.0})


def written(spark, name):
    return len(list(pathlib.Path(shared_folder(spark)).glob(f"{name}-*")))


def test_upsert_reads_the_panel_once(spark, folder):
    files = QUERIES["w7_upsert_long_features"](spark, folder).inputFiles()
    assert files and all("/long-input-" in f for f in files)


@pytest.mark.parametrize("query, name", [("w7_stored_features", "long-input"), ("b7_stored_batch", "prepared"), ("b14_stored_batch", "prepared"), ("w6_stored_articles", "prepared")])
def test_stores_and_batches_share_one_input(spark, folder, query, name):
    before = written(spark, name)
    QUERIES[query](spark, folder)
    assert written(spark, name) == before + 1
