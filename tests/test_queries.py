"""Every query that has SQL, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["kv_as_of"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "event_id" in plan.split("PushedFilters")[1].split("]")[0]
