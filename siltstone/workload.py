"""Random puts and gets in bulk: a number of keys with one shared value, then a share of them read."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.reads import multi_get


@dataclass(frozen=True)
class Workload:
    keys: int = 1_000_000
    key_bytes: int = 16
    value_bytes: int = 64
    read_percent: int = 50
    seed: int = 42


@dataclass(frozen=True)
class Result:
    writes: int
    reads: int
    found: int
    write_seconds: float
    read_seconds: float

    @property
    def writes_per_second(self) -> float:
        return self.writes / self.write_seconds

    @property
    def reads_per_second(self) -> float:
        return self.reads / self.read_seconds


def key_of(number, w: Workload):
    """A key's bytes: hashes of its number, as many as it takes."""
    digest = F.sha2(F.concat_ws(":", F.lit(w.seed), number), 512)
    return F.unhex(F.substr(digest, F.lit(1), F.lit(2 * w.key_bytes)))


def log(spark: SparkSession, w: Workload) -> DataFrame:
    value = F.unhex(F.substr(F.repeat(F.sha2(F.lit(str(w.seed)), 512), w.value_bytes // 64 + 1), F.lit(1), F.lit(2 * w.value_bytes)))
    return spark.range(w.keys).select(key_of(F.col("id"), w).alias("key"), value.alias("value"), (F.col("id") + 1).alias("seq"), F.lit(False).alias("tombstone"))


def asked(spark: SparkSession, w: Workload) -> DataFrame:
    """Keys drawn with repetition; all of them exist."""
    n = w.keys * w.read_percent // 100
    return spark.range(n).select(key_of(F.pmod(F.xxhash64("id", F.lit(w.seed)), F.lit(w.keys)), w).alias("key"))


def run(store, w: Workload) -> Result:
    """Writes and flushes, then reads."""
    began = time.perf_counter()
    store.append(log(store.spark, w))
    store.flush()
    wrote = time.perf_counter()
    keys = asked(store.spark, w)
    answers = multi_get(store.log(), keys)
    found = keys.join(answers.where("status = 'FOUND'").select("key"), "key").count()
    return Result(w.keys, w.keys * w.read_percent // 100, found, wrote - began, time.perf_counter() - wrote)
