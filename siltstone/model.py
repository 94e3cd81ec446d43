"""Schemas, options and statuses."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

LOG = StructType(
    [
        StructField("key", BinaryType(), False),
        StructField("value", BinaryType()),
        StructField("seq", LongType(), False),
        StructField("tombstone", BooleanType(), False),
    ]
)
COLUMNS = LOG.names
RUN = StructType([*LOG.fields, StructField("run_id", LongType(), False)])

FOUND, DELETED, ABSENT = "FOUND", "DELETED", "ABSENT"


class Strategy(Enum):
    NONE = "none"
    FULL = "full"
    TIERED = "tiered"
    LEVELED = "leveled"


@dataclass(frozen=True)
class Options:
    """What a store is opened with; the log is always durable."""

    bloom_filter: bool = True
    #: Flush when so many batches wait.
    pending_batches: int = 2
    #: Flush when so many bytes of newest entries wait; also the size at which compaction cuts runs.
    run_bytes: int = 256 << 20
    #: Flush when the first waiting batch has waited so long: at the next write, or by the background thread.
    flush_seconds: float | None = None
    #: Versions whose files stay readable.
    keep_versions: int = 5
    block_bytes: int = 4096
    strategy: Strategy = Strategy.NONE
    # size-tiered
    tier_runs: int = 4
    tier_factor: float = 2.0
    # leveled
    level0_runs: int = 4
    level1_bytes: int = 1 << 30
    level_factor: int = 10
    levels: int = 4

    def __post_init__(self) -> None:
        if min(self.pending_batches, self.run_bytes, self.block_bytes, self.level0_runs, self.levels, self.keep_versions) < 1 or self.tier_runs < 2:
            raise ValueError("options must be positive, and a tier has two runs or more")
        if self.tier_factor < 1 or self.level_factor < 2:
            raise ValueError("factors must be 1 (tiers) and 2 (levels) or more")


