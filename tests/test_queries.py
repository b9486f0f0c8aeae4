"""Every registered query that has SQL, held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from foldwise.plans import audits, cohort_audits, queries, readouts  # noqa: F401  the last registers with the second

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = queries.ORACLES | audits.ORACLES | cohort_audits.ORACLES
QUERIES = queries.QUERIES | audits.QUERIES | cohort_audits.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.5g}"
    except (TypeError, ValueError):
        return str(v)


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


def close(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-4, abs_tol=2e-6)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows_of(got), rows_of(want)
    assert len(got) == len(want)
    assert all(close(a, b) for x, y in zip(got, want) for a, b in zip(x, y)), next((x, y) for x, y in zip(got, want) if x != y)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
