"""Byte-level words and shingles of whole Arrow text columns, without a Python loop over words.

A word's 64-bit hash mixes its bytes in blocks of eight, each over what came before; words longer than MIXED
bytes have their xxHash. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
CHUNK = 1 << 19
#: Bytes of a word up to which blocks of eight are mixed.
MIXED = 64
_ODD = U(0x9E3779B97F4A7C15)
#: Keeps the first n of eight bytes.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The blanks of `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Words(NamedTuple):
    """Words of rows lo..hi of a column: byte ranges in data, each row's first word (with an end), hashes, eights of data."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    eight: np.ndarray

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the byte ranges start..end of data, whose eights are given."""
    size = end - start
    h = mix((eight[start] & FIRST[np.minimum(size, 8)]) ^ (size.astype(U) * _ODD))
    longer, k = np.flatnonzero(size > 8), 8
    while len(longer) and k < MIXED:
        block = eight[start[longer] + k] & FIRST[np.minimum(size[longer] - k, 8)]
        h[longer] = mix((h[longer] * _ODD) ^ block)
        k += 8
        longer = longer[size[longer] > k]
    for w in longer.tolist():
        h[w] = xxhash.xxh3_64_intdigest(data[start[w] : end[w]].data)
    return h


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes; a longer text makes a run of its own."""
    data, at = raw(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def release() -> None:
    """Gives memory that was freed back to the system: workers live on from stage to stage, beside a full heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def words(column: pa.Array, blank: np.ndarray = BLANK) -> Iterator[Words]:
    """Words in lower case (A-Z only) of all rows."""
    for lo, hi, data, offsets in chunks(column):
        data = LOWER[data]
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~blank[data]
        opens = solid[1:] & ~solid[:-1]
        closes = solid[:-1] & ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        both = inner[solid[inner] & solid[inner + 1]]  # a text ends in a word and the next begins with one
        opens[both] = closes[both] = True
        start, end = np.flatnonzero(opens), np.flatnonzero(closes)
        eight = eights(data)
        yield Words(lo, hi, data, offsets, start, end, np.searchsorted(start, offsets), hashes(data, eight, start, end), eight)


_STEP = U(0xD6E8FEB86659FD93)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len(h) - n + 1 of them, rows not regarded)."""
    if len(h) < n:
        return np.zeros(0, U)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _STEP
        out ^= out >> U(29)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-word shingles, ascending, and their offsets. Fewer words make one shingle, none make none."""
    g, sets, at = grams(w.hash, n), [], np.zeros(len(w.first), np.int64)
    first = w.first.tolist()
    for k in range(len(first) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif b > a:
            s = grams(w.hash[a:b], b - a) ^ U(b - a)
        else:
            s = g[:0]
        sets.append(s)
        at[k + 1] = at[k] + len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), at


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
