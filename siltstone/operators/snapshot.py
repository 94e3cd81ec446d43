"""The newest version wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.model import COLUMNS


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The newest version of each key (within each of `by`), tombstones too.

    One struct is compared, so that value and tombstone come from one version; partial aggregation leaves
    at most one version of a key for each task to shuffle.
    """
    newest = F.max_by(F.struct("value", "tombstone"), "seq").alias("newest")
    return log.groupBy(*by, "key").agg(newest, F.max("seq").alias("seq")).select(*by, "key", "newest.value", "seq", "newest.tombstone")


def live(log: DataFrame) -> DataFrame:
    """What a reader sees. Tombstones go after the newest version is known: before, they would bring deleted values back."""
    return latest(log).where("NOT tombstone").select("key", "value", "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """What a reader saw when seq was the last mutation."""
    return live(log.where(F.col("seq") <= seq).select(*COLUMNS))
