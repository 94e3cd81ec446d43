"""Puts and deletes as log rows, checked and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.model import COLUMNS


def entry(key: Column, value: Column, seq: Column, tombstone: Column) -> list[Column]:
    """One version of one key; a deleted one has no value."""
    return [
        key.cast("binary").alias("key"),
        F.when(~tombstone, value.cast("binary")).alias("value"),
        seq.cast("long").alias("seq"),
        tombstone.cast("boolean").alias("tombstone"),
    ]


def checked(log: DataFrame) -> DataFrame:
    """log; its use fails if a key is empty, or a value that isn't deleted."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    key = F.when(size("key") == 0, F.raise_error(F.lit("a key must not be empty")).cast("binary")).otherwise(F.col("key"))
    value = F.when(~F.col("tombstone") & (size("value") == 0), F.raise_error(F.lit("a value must not be empty")).cast("binary")).otherwise(F.col("value"))
    return log.withColumns({"key": key, "value": value})


def refused(log: DataFrame) -> DataFrame:
    """The rows that `checked` would fail on."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return log.where((size("key") == 0) | (~F.col("tombstone") & (size("value") == 0)))


def puts(rows: DataFrame, key: str, value: str, seq: str | Column) -> DataFrame:
    seq = F.col(seq) if isinstance(seq, str) else seq
    return checked(rows.select(*entry(F.col(key), F.col(value), seq, F.lit(False))))


def deletes(rows: DataFrame, key: str, seq: str | Column) -> DataFrame:
    """Tombstones, whether or not the keys exist."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return checked(rows.select(*entry(F.col(key), F.lit(None).cast("binary"), seq, F.lit(True))))


def numbered(staged: DataFrame, base: int) -> DataFrame:
    """Gives seq base + 1, base + 2, ... in the order of the column `place`: distinct whole numbers, gaps allowed.

    Counts per stretch of places replace one global sort: a stretch is what one range partition held.
    """
    counts = {r["stretch"]: r["n"] for r in staged.groupBy("stretch").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    ahead, offsets = base, []
    for stretch in sorted(counts):
        offsets.append((stretch, ahead))
        ahead += counts[stretch]
    spark = staged.sparkSession
    offsets = spark.createDataFrame(offsets, "stretch int, ahead long")
    out = staged.join(F.broadcast(offsets), "stretch").withColumn("seq", F.col("ahead") + F.col("place") + 1)
    return out.select(*COLUMNS)


def staged(rows: DataFrame, *order: str) -> DataFrame:
    """rows in order, with stretch (the partition) and place (the position in it): to be written and then `numbered`."""
    low = F.shiftleft(F.lit(1).cast("long"), 33) - 1
    return rows.orderBy(*order).withColumns({"stretch": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(low)})
