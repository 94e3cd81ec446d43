"""Queries that have SQL, against DuckDB."""

import duckdb
import pytest

from siltstone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())
