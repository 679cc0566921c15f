"""Every registered query against its DuckDB oracle on the smallest data."""

import re

import pytest

import __spark_entry__ as E
from tracelat.plans.compare import compare_one, duck

# the training-data operators have tests of their own
QUERIES = {n: q for n, q in E.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"sample_rows", "latency_summary_approx"}
    assert {n for n in ORACLE if not re.match(r"op\d+_", n)} <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    r = compare_one(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
    if ORACLE.get(name) is None:
        assert r["spark_rows"] >= 0
        return
    assert r["cols_ok"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns[:2] == ["total_rows", "non_null_latency_rows"]
