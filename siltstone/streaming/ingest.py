"""Mutations that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.model import COLUMNS
from siltstone.operators.snapshot import latest
from siltstone.plans.store import Store


def into_store(mutations: DataFrame, store: Store, name: str, checkpoint: str, *order: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of rows (key, value, tombstone) into the store, each micro-batch in order of the given columns.

    The manifest keeps the last batch number of each stream name in the same commit as the batch, so that a
    batch that is replayed after a failure is known and skipped. Backpressure: the source's own limits.
    """

    def one(batch: DataFrame, number: int) -> None:
        if number > store.manifest.streams.get(name, -1):
            store.ingest(batch, *order, source=f"{name}:{number}")

    writer = mutations.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def running_snapshot(log: DataFrame) -> DataFrame:
    """The newest version of each key of a streaming log, tombstones too.

    State is one version of each key. For complete or update mode; in update mode a key comes again with
    each batch that changes it, so a reader keeps the newest by seq.
    """
    return latest(log.select(*COLUMNS))
