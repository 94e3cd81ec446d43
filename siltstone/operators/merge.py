"""Merges of sorted runs, as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_runs(runs: DataFrame) -> DataFrame:
    """(key, value, seq, tombstone, run_id): of equal keys the entry of the newest run; tombstones stay."""
    newest = F.max_by(F.struct("value", "seq", "tombstone"), F.struct("run_id", "seq")).alias("e")
    return runs.groupBy("key").agg(newest, F.max("run_id").alias("run_id")).select("key", "e.value", "e.seq", "e.tombstone", "run_id")


def two_way_merge(newer: DataFrame, older: DataFrame) -> DataFrame:
    """All of newer, and of older what newer doesn't shadow."""
    return newer.unionByName(older.join(newer.select("key"), "key", "left_anti").select(*newer.columns))


def concat_runs(*runs: DataFrame) -> DataFrame:
    """Runs whose key ranges are disjoint; no shuffle."""
    return reduce(DataFrame.unionByName, runs)


def overlaps(manifest: DataFrame) -> DataFrame:
    """Pairs (a, b) of runs, a before b, whose key ranges meet."""
    a = manifest.select(F.col("run_id").alias("a"), F.col("first_key").alias("a_first"), F.col("last_key").alias("a_last"))
    b = manifest.select(F.col("run_id").alias("b"), F.col("first_key").alias("b_first"), F.col("last_key").alias("b_last"))
    return a.join(b, (F.col("a") < F.col("b")) & (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))).select("a", "b")


def prune(manifest: DataFrame, start: bytes | str, end: bytes | str | None = None) -> DataFrame:
    """The runs whose key range meets start..end (a single key if end is None)."""
    from siltstone.operators.reads import literal

    return manifest.where((F.col("first_key") <= literal(start if end is None else end)) & (F.col("last_key") >= literal(start)))


def level_check(manifest: DataFrame) -> DataFrame:
    """(level, run_id, ok): a level is valid where each run ends before the next one begins and begins before it ends."""
    from pyspark.sql import Window

    by = Window.partitionBy("level").orderBy("first_key", "run_id")
    after = F.lead("first_key").over(by)
    ok = (F.col("first_key") <= F.col("last_key")) & (after.isNull() | (F.col("last_key") < after))
    return manifest.select("level", "run_id", ok.alias("ok"))
