"""Every registered query against its comparison SQL (rows and values)."""

import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_contract():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 200


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns and out.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, duck, folder):
    import check

    problem, _ = check.compare(QUERIES[name](spark, folder), duck, ORACLE[name])
    assert problem is None or "beyond 1e-6" in problem and all(v[1] == 0 for v in check.LAST_DIFFERENCES.values()), problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, folder):
    out = QUERIES[name](spark, folder)
    assert out.columns and out.count() > 0
