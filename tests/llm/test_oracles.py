"""SQL that says the same as an operator, in DuckDB on the same files."""

import os

import duckdb
import pytest

from textloom.llm import entries


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    want = db.execute(entries.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    expected = sorted(tuple(dict(zip((d[0] for d in want.description), r, strict=True))[c] for c in columns) for r in want.fetchall())
    got = entries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == expected and expected
