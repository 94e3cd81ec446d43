"""Point reads, bulk reads and range scans over any log or union of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.model import ABSENT, DELETED, FOUND
from siltstone.operators.snapshot import latest

#: Keys asked for are broadcast up to this many bytes; more are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def literal(key: bytes | str) -> Column:
    return F.lit(bytearray(key.encode() if isinstance(key, str) else key))


def get(log: DataFrame, key: bytes | str) -> DataFrame:
    """(key, value, seq) if the key is live; the filter reaches the scan."""
    return latest(log.where(F.col("key") == literal(key))).where("NOT tombstone").select("key", "value", "seq")


def status(tombstone: str = "tombstone") -> Column:
    return F.when(F.col(tombstone).isNull(), ABSENT).when(F.col(tombstone), DELETED).otherwise(FOUND)


def multi_get(log: DataFrame, keys: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(key, status, value) of each distinct key of keys (key).

    Few keys are broadcast before the newest versions are found, so only their versions are shuffled.
    """
    keys = keys.select(F.col("key").cast("binary").alias("key")).distinct()
    if broadcast is None:
        size = keys.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0
        broadcast = size <= BROADCAST_BYTES
    wanted = F.broadcast(keys) if broadcast else keys
    newest = latest(log.join(wanted, "key", "left_semi"))
    return keys.join(newest, "key", "left").select("key", status().alias("status"), "value")


def seek(log: DataFrame, start: bytes | str) -> DataFrame:
    """Entries whose key is `start` or behind it, in order of key and then the newest first; no versions are resolved."""
    own = log.where(F.col("key") >= literal(start)) if start else log
    return own.orderBy(F.col("key").asc(), F.col("seq").desc())


def range_scan(log: DataFrame, start: bytes | str, end: bytes | str, limit: int | None = None) -> DataFrame:
    """Live entries from start to end, both included, in order of key."""
    inside = log.where((F.col("key") >= literal(start)) & (F.col("key") <= literal(end)))
    out = latest(inside).where("NOT tombstone").select("key", "value", "seq").orderBy("key")
    return out if limit is None else out.limit(limit)
