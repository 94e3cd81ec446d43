import zlib

import duckdb

from siltstone.llm import tables


def test_crc_in_spark_and_sql(spark):
    ids = [None, 0, 7, -3, 10**15, 123456789]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    want = [zlib.crc32(b"" if i is None else str(i).encode()) % 1000 for i in ids]
    assert [r[0] for r in df.select(tables.crc("doc_id", 1000)).collect()] == want
    values = ", ".join(f"({'NULL' if i is None else i}::BIGINT)" for i in ids)
    assert [r[0] for r in duckdb.sql(f"SELECT {tables.crc_sql(1000)} FROM (VALUES {values}) t(doc_id)").fetchall()] == want


def test_small_tables_are_spread_and_larger_ones_read_as_they_lie(spark, tmp_path, monkeypatch):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    parts = lambda: {r[0] for r in tables.table(spark, str(tmp_path), "t").selectExpr("spark_partition_id()").distinct().collect()}
    assert len(parts()) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "SMALL", 100)
    assert len(parts()) == 1
    assert tables.table(spark, str(tmp_path), "t").count() == 5000


def test_written_rows_come_back(spark):
    df = spark.range(10).selectExpr("id", "array(id) AS a", "CAST(NULL AS STRING) AS n")
    assert sorted(map(tuple, tables.written(df).collect())) == [(k, [k], None) for k in range(10)]
