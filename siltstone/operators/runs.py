"""From a log to sorted runs: where batches are cut, and what a run's manifest row says."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from siltstone.model import COLUMNS, LOG
from siltstone.operators.snapshot import latest
from siltstone.sources.manifest import Files
from siltstone.sources.scratch import scratch

#: Mutations and bytes of them that one task of `frozen_by_bytes` sorts and folds.
STRETCH, STRETCH_BYTES = 1_000_000, 64 << 20
_FOLDED = StructType([StructField(f.name, f.dataType) for f in LOG.fields] + [StructField("run_id", LongType()), StructField("held", LongType())])


def entry_bytes() -> Column:
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


def frozen(log: DataFrame, batch: int) -> DataFrame:
    """log with run_id: `batch` mutations make a run."""
    return log.withColumn("run_id", F.floor((F.col("seq") - 1) / F.lit(batch)).cast("long"))


def frozen_by_bytes(log: DataFrame, most: int, stretch: int = STRETCH) -> DataFrame:
    """log with run_id, cut as a memtable would: a run ends with the mutation that brings the newest entries to `most` bytes.

    The total falls when a value is overwritten and starts again with each run, so this is a fold in order of
    seq. A log of more than `stretch` mutations (or STRETCH_BYTES) is written in stretches of seq, which are folded
    one after the other, each by a task that sorts and holds no more than its own; the run that is open at the end
    of one is written with it and read by the next. Only the keys of one run are held, by no one but that task.
    """
    spark = log.sparkSession
    log = log.select(*COLUMNS)
    n, size = log.agg(F.count("*"), F.coalesce(F.sum(entry_bytes()), F.lit(0))).first()
    many = max(-(-n // stretch), -(-size // STRETCH_BYTES))
    if many <= 1:
        return _folded(_mutations(log), most).where("held IS NULL").drop("held")
    path = scratch(spark, "frozen")
    schema = StructType([*LOG.fields, StructField("stretch", IntegerType())])
    ranges = log.repartitionByRange(many, "seq").withColumn("stretch", F.spark_partition_id())
    ranges.sortWithinPartitions("stretch", "seq").write.partitionBy("stretch").parquet(f"{path}/stretches")
    stretches = spark.read.schema(schema).parquet(f"{path}/stretches")
    folded = [f"{path}/folded/{k}" for k in range(many)]
    for k, to in enumerate(folded):
        own = _mutations(stretches.where(F.col("stretch") == k))
        if k:
            own = own.unionByName(spark.read.schema(_FOLDED).parquet(folded[k - 1]).where("held IS NOT NULL"))
        _folded(own, most).write.parquet(to)
    Files(spark, path).delete(f"{path}/stretches")
    return spark.read.schema(_FOLDED).parquet(*folded).where("held IS NULL").drop("held")


def _mutations(log: DataFrame) -> DataFrame:
    """log as `_folded` takes it: of no run yet."""
    return log.select(*COLUMNS).withColumns({c: F.lit(None).cast("long") for c in ("run_id", "held")})


def _folded(rows: DataFrame, most: int) -> DataFrame:
    """rows with their run_id, and the open run: a row for each of its keys, with its bytes in `held`, and one without a key.

    rows: mutations, and the open run before them.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, total = 0, {}, 0
        for b in batches:
            ids = []
            more = pc.add(pc.binary_length(b.column(0)), pc.fill_null(pc.binary_length(b.column(1)), 0))
            for key, size, before, own in zip(*(c.to_pylist() for c in (b.column(0), more, b.column(4), b.column(5))), strict=True):
                ids.append(run)
                if own is not None:  # of the open run
                    run = before
                    if key is not None:
                        held[key] = own
                        total += own
                    continue
                total += size - held.get(key, 0)
                held[key] = size
                if total >= most:
                    run, held, total = run + 1, {}, 0
            out = pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.int64()), b.column(5)], b.schema.names)
            yield out.filter(pc.is_null(b.column(5)))
        n = len(held) + 1
        open_run = [pa.array([*held, None], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array([run] * n, pa.int64()), pa.array([*held.values(), 0], pa.int64())]
        yield pa.RecordBatch.from_arrays(open_run, _FOLDED.names)

    return rows.repartition(1).sortWithinPartitions(F.col("held").isNull(), "seq").mapInArrow(fold, _FOLDED)


def flushed(frozen_log: DataFrame) -> DataFrame:
    """(run_id, key, value, seq, tombstone): one version of each key in each run, tombstones too."""
    return latest(frozen_log, "run_id")


def manifest_rows(runs: DataFrame, *by: str) -> DataFrame:
    """One row for each run: counts, bytes, ranges of keys and seqs."""
    return runs.groupBy(*(by or ("run_id",))).agg(
        F.count("*").alias("n_rows"),
        F.count_if("tombstone").alias("n_tombstones"),
        F.sum(entry_bytes()).alias("bytes"),
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )
