"""A store in a folder: a durable log of batches, sorted runs, and the manifest that says what holds.

One writer at a time (the threads of one store take turns); the manifest's rename tells a second one so. Reads see one version of the manifest, and
its files stay for as many versions as `Options.keep_versions` says, so frames outlive a flush or a merge.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siltstone.model import ABSENT, DELETED, FOUND, LOG, Options, Strategy
from siltstone.operators import mutations, reads
from siltstone.operators.runs import entry_bytes, manifest_rows
from siltstone.operators.snapshot import as_of, latest, live
from siltstone.plans import compaction
from siltstone.sources.manifest import Batch, Catalog, Files, Manifest, Run


#: Bytes of entries that a task writes, at least where there are more tasks than cores.
TASK_BYTES = 32 << 20


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None) -> None:
        """Opens or makes the store; ids and seqs go on where they were."""
        self.spark, self.options = spark, options or Options()
        self.files = Files(spark, path)
        self.catalog = Catalog(self.files, self.options.keep_versions)
        self.manifest = self.catalog.load()
        self.closed = False
        #: Held where the manifest changes. Runs are written without it: their inputs never change.
        self.lock = threading.RLock()
        self._working = threading.Lock()
        self._waiting_since = 0.0
        self._stop: threading.Event | None = None
        self._thread: threading.Thread | None = None
        self.failure: Exception | None = None

    # writes

    def put(self, key: bytes | str, value: bytes | str) -> int:
        return self.write([(key, value)])

    def delete(self, key: bytes | str) -> int:
        return self.write([(key, None)])

    def write(self, entries: Iterable[tuple[bytes | str, bytes | str | None]]) -> int:
        """Puts, or deletes where the value is None, in this order; all or none. The last seq."""
        with self.lock:
            rows, seq = [], self.manifest.last_seq
            for key, value in entries:
                if not _bytes(key) or value is not None and not _bytes(value):
                    raise ValueError("a key or value must not be empty")
                seq += 1
                rows.append((bytearray(_bytes(key)), None if value is None else bytearray(_bytes(value)), seq, value is None))
            if rows:
                self._append(self.spark.createDataFrame(rows, LOG).coalesce(1))
        self._after_write()
        return seq

    def ingest(self, rows: DataFrame, *order: str, source: str | None = None) -> int:
        """Rows (key, value, tombstone) in order of the given columns, which must tell any two rows apart."""
        self._open()
        if not order:
            raise ValueError("rows have no order of their own: name the columns that give it")
        columns = [F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("tombstone")]
        path = f"{self.files.root}/staged/{uuid.uuid4().hex}"
        staged = mutations.staged(rows, *order).select(*columns, "stretch", "place")
        mutations.checked(staged).write.parquet(path)
        try:
            with self.lock:
                self._append(mutations.numbered(self.spark.read.parquet(path), self.manifest.last_seq), source)
                last = self.manifest.last_seq
        finally:
            self.files.delete(path)
        self._after_write()
        return last

    def append(self, log: DataFrame, source: str | None = None) -> int:
        """A log (key, value, seq, tombstone) whose seqs all lie behind the last one."""
        self._open()
        low = log.agg(F.min("seq")).first()[0]
        with self.lock:
            if low is not None and low <= self.manifest.last_seq:
                raise ValueError(f"seq {low} isn't behind {self.manifest.last_seq}")
            self._append(log, source)
            last = self.manifest.last_seq
        self._after_write()
        return last

    def _append(self, log: DataFrame, source: str | None = None) -> None:
        self._open()
        path = f"{self.files.root}/log/{uuid.uuid4().hex}"
        mutations.checked(log.select(*LOG.names)).write.parquet(path)
        self._commit_batch(path, source)

    def flush_due(self) -> bool:
        """Whether enough batches or bytes wait, or the first of them has waited long enough."""
        waiting, seconds = self.manifest.batches, self.options.flush_seconds
        if not waiting:
            return False
        late = seconds is not None and time.monotonic() - self._waiting_since >= seconds
        return late or len(waiting) >= self.options.pending_batches or sum(b.bytes for b in waiting) >= self.options.run_bytes

    def _after_write(self) -> None:
        """Flushes if it's due; a background thread, where there is one, does it instead."""
        if not self._in_background() and self.flush_due():
            self.flush()

    def _in_background(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def _commit_batch(self, path: str, source: str | None) -> None:
        own = self.spark.read.schema(LOG).parquet(path)
        n, size, low, high = own.agg(F.count("*"), F.coalesce(F.sum(entry_bytes()), F.lit(0)), F.min("seq"), F.max("seq")).first()
        changes: dict = {}
        if source is not None:
            name, _, number = source.rpartition(":")
            changes["streams"] = self.manifest.streams | {name: int(number)}
        if n:
            if not self.manifest.batches:
                self._waiting_since = time.monotonic()
            changes |= {"batches": (*self.manifest.batches, Batch(path, n, size, low, high, source)), "last_seq": max(high, self.manifest.last_seq)}
        if changes:
            self.manifest = self.catalog.commit(self.manifest, **changes)

    def flush(self) -> list[Run]:
        """The waiting batches become one sorted run of level 0, tombstones too."""
        self._open()
        with self._working:
            waiting = self.manifest.batches
            if not waiting:
                return []
            written = self._write_runs(latest(self._log(waiting)), 0, sum(b.bytes for b in waiting), sum(b.n_rows for b in waiting), parts=False)
            runs = self._swap(written, batches=waiting)
        if self.options.strategy is not Strategy.NONE and not self._in_background():
            self.compact()
        return list(runs)

    def _swap(self, written: list[Run], runs: Iterable[Run] = (), batches: Iterable[Batch] = ()) -> list[Run]:
        """One new version in which the written runs, numbered now, take the place of others."""
        with self.lock:
            m = self.manifest
            gone, done = {r.run_id for r in runs}, {b.path for b in batches}
            new = [replace(r, run_id=m.next_run + k) for k, r in enumerate(written)]
            kept = (*(r for r in m.runs if r.run_id not in gone), *new)
            self.manifest = self.catalog.commit(m, runs=kept, batches=tuple(b for b in m.batches if b.path not in done), next_run=m.next_run + len(new))
            self._waiting_since = time.monotonic()
        return new

    def _write_runs(self, entries: DataFrame, level: int, size: int, rows: int, parts: bool) -> list[Run]:
        """Range-sorted runs, not numbered yet; each range is a run of its own if `parts`, else all are one."""
        path = f"{self.files.root}/runs/{uuid.uuid4().hex}"
        ranges = max(1, -(-size // self.options.run_bytes))
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))  # small runs don't each need a task
        if not parts:
            ranges = min(ranges, tasks)
        out = entries.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id() if parts else F.lit(0))
        if tasks < ranges:
            out = out.coalesce(tasks)
        writer = out.sortWithinPartitions("part", "key").write.partitionBy("part").option("parquet.page.write-checksum.enabled", "true")
        if self.options.bloom_filter:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, rows // ranges)))
        writer.parquet(path)
        own = self.spark.read.schema(StructType([*LOG.fields, StructField("part", IntegerType())])).parquet(path)  # without rows there are no parts
        got = manifest_rows(own, "part").orderBy("first_key").collect()
        return [
            Run(
                0, level, f"{path}/part={r['part']}", r["n_rows"], r["n_tombstones"], r["bytes"],
                bytes(r["first_key"]), bytes(r["last_key"]), r["min_seq"], r["max_seq"],
            )
            for r in got
        ]

    def compact(self, strategy: Strategy | None = None) -> list[compaction.Task]:
        """Merges until the strategy finds nothing more to do."""
        self._open()
        done: list[compaction.Task] = []
        while (task := compaction.plan(list(self.manifest.runs), self.options, strategy)) is not None and task not in done[-1:]:
            self.merge(task)
            done.append(task)
        return done

    def merge(self, task: compaction.Task) -> None:
        with self._working:
            asked = set(task.inputs)
            inputs = [r for r in self.manifest.runs if r.run_id in asked]
            if len(inputs) != len(task.inputs):
                raise ValueError("a task's runs must all be there")
            merged = latest(self._log(inputs))
            if task.drop_tombstones:
                merged = merged.where("NOT tombstone")
            written = self._write_runs(merged, task.level, sum(r.bytes for r in inputs), sum(r.n_rows for r in inputs), parts=task.level > 0)
            self._swap(written, runs=inputs)

    def background(self, every: float = 0.1) -> None:
        """Flushes and compacts in a thread of its own, so that writes wait for neither, until the store is closed.

        What goes wrong there is kept in `failure` and raised by `close`.
        """
        self._open()
        if self._thread is not None:
            return
        stop = self._stop = threading.Event()

        def work() -> None:
            while not stop.wait(every):
                try:
                    if self.flush_due():
                        self.flush()
                        if self.options.strategy is not Strategy.NONE:
                            self.compact()
                except Exception as e:  # noqa: BLE001
                    self.failure = e
                    return

        self._thread = threading.Thread(target=work, daemon=True, name="store")
        self._thread.start()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes what only versions before the newest `keep` have, and what writers that failed left. The folders removed.

        Frames that were made before it may lose their files.
        """
        self._open()
        with self._working, self.lock:
            return self.catalog.vacuum(keep)

    # reads

    def _log(self, parts: Iterable[Run | Batch]) -> DataFrame:
        paths = [p.path for p in parts]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def log(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """Versions that are still there, of runs whose key range meets start..end and of waiting batches."""
        m = self.manifest
        return self._log([*(m.runs if start is None else m.pruned(start, end)), *m.batches])

    def snapshot(self, seq: int | None = None) -> DataFrame:
        """(key, value, seq) of all live keys; with seq, as far back as versions are kept: flush and merge keep the newest."""
        return live(self.log()) if seq is None else as_of(self.log(), seq)

    def status(self, key: bytes | str) -> tuple[str, bytes | None]:
        """FOUND with the value, DELETED or ABSENT."""
        k = _bytes(key)
        got = latest(self.log(k, k).where(F.col("key") == reads.literal(k))).collect()
        if not got:
            return ABSENT, None
        return (DELETED, None) if got[0]["tombstone"] else (FOUND, bytes(got[0]["value"]))

    def get(self, key: bytes | str) -> bytes | None:
        return self.status(key)[1]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        low, high = keys.agg(F.min(F.col("key").cast("binary")), F.max(F.col("key").cast("binary"))).first()
        return reads.multi_get(self.log(bytes(low), bytes(high)) if low is not None else self._log([]), keys)

    def range_scan(self, start: bytes | str, end: bytes | str, limit: int | None = None) -> DataFrame:
        return reads.range_scan(self.log(_bytes(start), _bytes(end)), start, end, limit)

    def level_scan(self, level: int, start: bytes | str = b"") -> DataFrame:
        """Entries of one level from a key on, in order, tombstones too; level 0 may hold more than one version of a key."""
        runs = [r for r in self.manifest.runs if r.level == level and r.last_key >= _bytes(start)]
        return reads.seek(self._log(runs), start)

    def block_index(self, block_bytes: int | None = None) -> DataFrame:
        """(run_id, block_id, n_entries, first_key, last_key, crc) of all runs."""
        from siltstone.functions import codec

        tail = lambda c: F.regexp_extract(c, r"runs/([0-9a-f]+/part=\d+)", 1)
        ids = self.manifest.frame(self.spark).select("run_id", tail(F.col("path")).alias("part"))  # a row for each run
        own = self._log(self.manifest.runs)
        part = tail(F.col("_metadata.file_path")) if self.manifest.runs else F.lit("")
        runs = own.withColumn("part", part).join(ids, "part").drop("part")
        return codec.blocks(runs, block_bytes or self.options.block_bytes).drop("block")

    # life

    def reload(self) -> Manifest:
        self.manifest = self.catalog.load()
        return self.manifest

    def reopen(self, **options) -> Store:
        return Store(self.spark, self.files.root, replace(self.options, **options))

    def close(self) -> None:
        """Flushes; a closed store can be read and not written."""
        if self._thread is not None:
            self._stop.set()
            self._thread.join()
            self._thread = None
        if not self.closed:
            if self.failure is not None:
                self.closed = True
                raise self.failure
            self.flush()
            self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()
