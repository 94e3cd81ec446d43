"""Bloom filters over crc32 of the key, as built-in expressions.

A filter is a table of words (run_id, word, bits): 64 bits each, so that building is one aggregation and
probing one equi-join, whatever the size of a run. `pack` makes one byte string of a small filter.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FPR = 0.01


class Shape(NamedTuple):
    bits: int
    probes: int


def shape(n: int, fpr: float = FPR) -> Shape:
    """Bits and probes for n keys."""
    per_key = _per_key(fpr)
    return Shape(-(-max(64, per_key * n) // 8) * 8, _probes(fpr))


def _per_key(fpr: float) -> int:
    return math.ceil(-math.log(fpr) / math.log(2) ** 2)


def _probes(fpr: float) -> int:
    return min(30, max(1, math.ceil(_per_key(fpr) * math.log(2))))


def shape_columns(n: Column, fpr: float = FPR) -> dict[str, Column]:
    per_key = F.lit(_per_key(fpr)).cast("long")
    return {
        "bits_per_key": per_key,
        "probes": F.lit(_probes(fpr)),
        "bits": F.ceil(F.greatest(F.lit(64).cast("long"), per_key * n) / F.lit(8)) * F.lit(8).cast("long"),
    }


def positions(key: Column, bits: Column, probes: int) -> Column:
    """Where the bits of a key lie: (h + i * d) mod bits, with d the hash turned by 15 bits in a wide register."""
    h = F.crc32(key)
    d = F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(probes - 1).cast("long")), lambda i: (h + i * d) % bits)


def build(runs: DataFrame, sizes: DataFrame, fpr: float = FPR) -> DataFrame:
    """(run_id, word, bits): sizes has (run_id, bits). At most one row for each task, run and word is shuffled."""
    at = runs.select("run_id", "key").join(sizes.select("run_id", F.col("bits").alias("_bits")), "run_id")
    at = at.select("run_id", F.explode(positions(F.col("key"), F.col("_bits"), _probes(fpr))).alias("at"))
    word = F.shiftright("at", 6)
    bit = F.expr("shiftleft(1L, CAST(at % 64 AS INT))")
    return at.groupBy("run_id", word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def probe(pairs: DataFrame, filters: DataFrame, sizes: DataFrame, fpr: float = FPR) -> DataFrame:
    """(run_id, key, may_contain) of each pair (run_id, key); never false where the run holds the key."""
    at = pairs.select("run_id", "key").join(sizes.select("run_id", F.col("bits").alias("_bits")), "run_id")
    at = at.select("run_id", "key", F.explode(positions(F.col("key"), F.col("_bits"), _probes(fpr))).alias("at"))
    at = at.select("run_id", "key", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit"))
    hit = at.join(filters, ["run_id", "word"], "left")
    set_ = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")), F.lit(0)) != 0
    return hit.groupBy("run_id", "key").agg(F.bool_and(set_).alias("may_contain"))


def pack(keys: list[bytes], fpr: float = FPR) -> bytes:
    """The filter of a few keys as bytes."""
    bits, probes = shape(len(keys), fpr)
    out = bytearray(bits // 8)
    for key in keys:
        for at in _positions(key, bits, probes):
            out[at >> 3] |= 1 << (at & 7)
    return bytes(out)


def _positions(key: bytes, bits: int, probes: int) -> list[int]:
    h = zlib.crc32(key)
    d = h >> 17 | h << 15
    return [(h + i * d) % bits for i in range(probes)]


def contains(packed: bytes, key: bytes, fpr: float = FPR) -> bool:
    return all(packed[at >> 3] >> (at & 7) & 1 for at in _positions(key, len(packed) * 8, _probes(fpr)))


def encode(packed: bytes, fpr: float = FPR) -> bytes:
    """filter, number of probes, crc32."""
    body = packed + bytes([_probes(fpr)])
    return body + zlib.crc32(body).to_bytes(4, "big")


def decode(data: bytes) -> tuple[bytes, int]:
    if len(data) < 6 or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "big"):
        raise ValueError("a filter's checksum is wrong")
    return data[:-5], data[-5]
