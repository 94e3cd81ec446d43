"""Blocks of entries as bytes, with real errors on reading. For export and checks: runs themselves are Parquet.

An entry is the key's length, the key, the value's length and the value, lengths as LEB128; an empty value
is a tombstone. Behind the entries come their offsets and their number, 16 bits each, high byte first.

In the prefixed layout an entry is how many bytes its key shares with the block's first key and how many follow,
those bytes, the value's length and the value, all lengths of 16 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Entry = tuple[bytes, bytes | None]


class BlockError(ValueError):
    pass


def varint(n: int) -> bytes:
    if n < 0:
        raise ValueError("lengths aren't negative")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at `at` and where it ends."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BlockError("a length isn't complete")
        n |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return n, at
        shift += 7


def entry(key: bytes, value: bytes | None) -> bytes:
    if not key:
        raise BlockError("a key must not be empty")
    value = value or b""
    return varint(len(key)) + key + varint(len(value)) + value


def size(entries: int, data: int) -> int:
    """Bytes of a block."""
    return 2 + 2 * entries + data


def encode(entries: list[Entry]) -> bytes:
    if not entries:
        raise BlockError("a block must not be empty")
    data, offsets = bytearray(), []
    for key, value in entries:
        offsets.append(len(data))
        data += entry(key, value)
    if offsets[-1] > 0xFFFF or len(offsets) > 0xFFFF:
        raise BlockError("a block's offsets have 16 bits")
    return bytes(data) + b"".join(x.to_bytes(2, "big") for x in [*offsets, len(offsets)])


def decode(block: bytes) -> list[Entry]:
    if len(block) < 2:
        raise BlockError("a block has two bytes or more")
    n = int.from_bytes(block[-2:], "big")
    end = len(block) - 2 - 2 * n
    if n == 0 or end < 0:
        raise BlockError(f"a block of {len(block)} bytes can't have {n} entries")
    offsets = [int.from_bytes(block[end + 2 * k : end + 2 * k + 2], "big") for k in range(n)]
    out: list[Entry] = []
    for k, at in enumerate(offsets):
        stop = offsets[k + 1] if k + 1 < n else end
        parts = []
        for _ in range(2):
            length, at = read_varint(block[:end], at)
            if at + length > end:
                raise BlockError("an entry goes beyond its block")
            parts.append(block[at : at + length])
            at += length
        if at != stop:
            raise BlockError("an entry isn't as long as its offsets say")
        out.append((parts[0], parts[1] or None))
    return out


def overlap(first: bytes, key: bytes) -> int:
    """How many leading bytes two keys share."""
    n = min(len(first), len(key))
    return next((k for k in range(n) if first[k] != key[k]), n)


def encode_prefixed(entries: list[Entry]) -> bytes:
    """A block in the prefixed layout; its offsets and their number are as in `encode`."""
    if not entries:
        raise BlockError("a block must not be empty")
    first, data, offsets = entries[0][0], bytearray(), []
    for k, (key, value) in enumerate(entries):
        value = value or b""
        if not key or max(len(key), len(value)) > 0xFFFF:
            raise BlockError("keys aren't empty, and lengths have 16 bits")
        offsets.append(len(data))
        shared = overlap(first, key) if k else 0
        data += shared.to_bytes(2, "big") + (len(key) - shared).to_bytes(2, "big") + key[shared:] + len(value).to_bytes(2, "big") + value
    if offsets[-1] > 0xFFFF or len(offsets) > 0xFFFF:
        raise BlockError("a block's offsets have 16 bits")
    return bytes(data) + b"".join(x.to_bytes(2, "big") for x in [*offsets, len(offsets)])


def decode_prefixed(block: bytes) -> list[Entry]:
    cursor = Cursor(block, prefixed=True)
    out = []
    while cursor.valid():
        out.append((cursor.key, cursor.value or None))
        cursor.next()
    return out


class Cursor:
    """Walks over one block's entries, which are read as they are asked for."""

    def __init__(self, block: bytes, prefixed: bool = False) -> None:
        if len(block) < 2:
            raise BlockError("a block has two bytes or more")
        self.n = int.from_bytes(block[-2:], "big")
        end = len(block) - 2 - 2 * self.n
        if self.n == 0 or end < 0:
            raise BlockError(f"a block of {len(block)} bytes can't have {self.n} entries")
        self.data, self.prefixed = block[:end], prefixed
        self.offsets = [int.from_bytes(block[end + 2 * k : end + 2 * k + 2], "big") for k in range(self.n)]
        self.at, self.key, self.value, self.first = 0, b"", b"", b""
        self.seek_first()
        self.first = self.key

    def valid(self) -> bool:
        return self.at < self.n

    def _take(self, at: int, size: int) -> tuple[bytes, int]:
        if at + size > len(self.data):
            raise BlockError("an entry goes beyond its block")
        return self.data[at : at + size], at + size

    def seek_offset(self, offset: int) -> None:
        """The entry whose bytes begin at an offset."""
        if self.prefixed:
            lengths, at = self._take(offset, 4)
            shared, rest = int.from_bytes(lengths[:2], "big"), int.from_bytes(lengths[2:], "big")
            tail, at = self._take(at, rest)
            self.key = self.first[:shared] + tail
            size, at = self._take(at, 2)
            self.value, _ = self._take(at, int.from_bytes(size, "big"))
        else:
            size, at = read_varint(self.data, offset)
            self.key, at = self._take(at, size)
            size, at = read_varint(self.data, at)
            self.value, _ = self._take(at, size)

    def seek_to(self, k: int) -> None:
        """The k-th entry; beyond the last one the cursor isn't valid."""
        self.at = k
        if self.valid():
            self.seek_offset(self.offsets[k])
        else:
            self.key = self.value = b""

    def seek_first(self) -> None:
        self.seek_to(0)

    def next(self) -> None:
        self.seek_to(self.at + 1)

    def seek(self, key: bytes) -> None:
        """The first entry whose key is `key` or behind it; not valid if all are before it."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            self.seek_to(mid)
            lo, hi = (mid + 1, hi) if self.key < key else (lo, mid)
        self.seek_to(lo)


def seek(entries: list[Entry], key: bytes) -> Entry | None:
    """The first entry whose key is `key` or behind it."""
    lo, hi = 0, len(entries)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if entries[mid][0] < key else (lo, mid)
    return entries[lo] if lo < len(entries) else None


#: Bytes of a batch that become Python objects at a time; a row larger than that is taken alone or with few others.
AT_ONCE = 1 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about AT_ONCE bytes: Spark's batches have 10,000 rows, however large."""
    rows = max(1, batch.num_rows * AT_ONCE // max(batch.nbytes, 1))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def blocks(runs: DataFrame, block_bytes: int = 4096, prefixed: bool = False) -> DataFrame:
    """(run_id, block_id, n_entries, first_key, last_key, crc, block): entries of a run in order, as many to a block as fit.

    An entry larger than a block has one of its own. A run is read as a stream; some AT_ONCE bytes and one block are held.
    """
    schema = "run_id long, block_id int, n_entries int, first_key binary, last_key binary, crc long, block binary"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, number, own, data = None, 0, [], 0

        def row() -> tuple:
            block = encode_prefixed(own) if prefixed else encode(own)
            return run, number, len(own), own[0][0], own[-1][0], zlib.crc32(block), block

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        for b in (part for whole in batches for part in slices(whole)):
            rows = []
            for at, key, value in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                more = len(entry(key, value))
                if own and (at != run or size(len(own) + 1, data + more) > block_bytes):
                    rows.append(row())
                    number, own, data = (number + 1 if at == run else 0), [], 0
                run = at
                own.append((key, value))
                data += more
            yield batch_of(rows)
        if own:
            yield batch_of([row()])

    return runs.select("run_id", "key", "value").repartition("run_id").sortWithinPartitions("run_id", "key").mapInArrow(fold, schema)


def entries(blocks: DataFrame, prefixed: bool = False) -> DataFrame:
    """(run_id, block_id, key, value, tombstone) of blocks; an error if a checksum or a block is wrong."""
    schema = "run_id long, block_id int, key binary, value binary, tombstone boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            out = []
            for run, number, crc, block in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if zlib.crc32(block) != crc:
                    raise BlockError(f"the checksum of block {number} of run {run} is wrong")
                out += [(run, number, k, v, v is None) for k, v in (decode_prefixed(block) if prefixed else decode(block))]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return blocks.select("run_id", "block_id", "crc", "block").mapInArrow(read, schema)
