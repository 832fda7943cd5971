"""Every query with SQL against DuckDB on the same files."""

import math
import os

import duckdb
import pytest

from textloom.plans import dispatch, entities, feeds, history, indexes, more, objects, queries as plans, rules  # noqa: F401

SF = os.environ.get("TEXTLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return db


def plain(x):
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else str(x)
    return x


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    expected = sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in want.fetchall()), key=str)
    assert rows == expected
    assert rows


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
