import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstone.functions import bloom, codec

ENTRIES = [(b"apple", b"value1"), (b"application", b"\x0d\x0e\xff"), (b"apricot", b"val2"), (b"banana", b"value3")]
GOLDEN = "056170706c650676616c7565310b6170706c69636174696f6e030d0eff0761707269636f740476616c320000000d001d0003"


def test_golden_block():
    sizes, data = [], 0
    for n, e in enumerate(ENTRIES, 1):
        data += len(codec.entry(*e))
        sizes.append(codec.size(n, data))
    assert sizes == [17, 35, 50, 66]
    block = codec.encode(ENTRIES[:3])
    assert block.hex() == GOLDEN and zlib.crc32(block) == 0x950A4B62
    assert codec.decode(block) == ENTRIES[:3]


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=300), st.binary(max_size=300)), min_size=1, max_size=40))
def test_round_trip(entries):
    assert codec.decode(codec.encode(entries)) == [(k, v or None) for k, v in entries]


@given(st.integers(0, 2**63 - 1))
def test_varint(n):
    data = codec.varint(n)
    assert codec.read_varint(data, 0) == (n, len(data))


@given(st.binary(max_size=60))
def test_junk_is_an_error_or_a_block(data):
    try:
        assert codec.encode(codec.decode(data))
    except codec.BlockError:
        pass


@pytest.mark.parametrize("data", [bytes.fromhex("453602"), b"", b"\0", b"\0\0", b"\x80\x80\0\0\0\1", bytes.fromhex(GOLDEN)[1:]])
def test_damaged_blocks(data):
    with pytest.raises(codec.BlockError):
        codec.decode(data)


def test_empty_is_refused():
    with pytest.raises(codec.BlockError):
        codec.encode([])
    with pytest.raises(codec.BlockError):
        codec.encode([(b"", b"x")])


def test_seek_is_a_lower_bound():
    assert codec.seek(ENTRIES, b"appl") == ENTRIES[0]
    assert codec.seek(ENTRIES, b"apple") == ENTRIES[0]
    assert codec.seek(ENTRIES, b"applf") == ENTRIES[1]
    assert codec.seek(ENTRIES, b"c") is None


def test_golden_filter():
    keys = [b"key1", b"abcdsd", b"keys2"]
    assert bloom.shape(3) == (64, 7)
    assert bloom.pack(keys).hex() == "1101151411504041"
    data = bloom.encode(bloom.pack(keys))
    assert bloom.decode(data) == (bloom.pack(keys), 7)
    for k in range(len(data)):
        with pytest.raises(ValueError):
            bloom.decode(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])


def test_filter_rates():
    r = random.Random(1)
    keys = [r.randbytes(16) for _ in range(1000)]
    packed = bloom.pack(keys)
    assert all(bloom.contains(packed, k) for k in keys)
    wrong = sum(bloom.contains(packed, r.randbytes(16)) for _ in range(20_000)) / 20_000
    assert wrong < 0.015


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), v and bytearray(v), s, v is None, r) for r, s, k, v in rows], "key binary, value binary, seq long, tombstone boolean, run_id long")


def test_blocks_of_runs(spark):
    rows = [(1, 1, b"banana", b"value3"), (1, 2, b"apple", b"value1"), (1, 3, b"apricot", b"val2"), (1, 4, b"application", b"\x0d\x0e\xff"), (2, 5, b"k", None), (2, 6, b"wide", b"x" * 5000), (2, 7, b"z", b"1")]
    blocks = codec.blocks(frame(spark, rows), 50)
    got = sorted((b.run_id, b.block_id, b.n_entries, bytes(b.first_key), bytes(b.last_key)) for b in blocks.collect())
    assert got == [(1, 0, 3, b"apple", b"apricot"), (1, 1, 1, b"banana", b"banana"), (2, 0, 1, b"k", b"k"), (2, 1, 1, b"wide", b"wide"), (2, 2, 1, b"z", b"z")]
    back = sorted((e.run_id, bytes(e.key), e.value and bytes(e.value), e.tombstone) for e in codec.entries(blocks).collect())
    assert back == sorted((r, k, v, v is None) for r, _, k, v in rows)
    assert codec.blocks(frame(spark, rows).limit(0)).count() == 0


def test_a_flipped_byte_is_an_error(spark):
    from pyspark.sql import functions as F

    blocks = codec.blocks(frame(spark, [(1, 1, b"a", b"b")]))
    with pytest.raises(Exception, match="checksum"):
        codec.entries(blocks.withColumn("crc", F.col("crc") + 1)).collect()


def test_filter_frames_agree_with_bytes(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    keys = {run: [r.randbytes(r.randrange(1, 20)) for _ in range(30 * run)] for run in (1, 2)}
    runs = frame(spark, [(run, s, k, b"v") for run, ks in keys.items() for s, k in enumerate(ks)])
    sizes = runs.groupBy("run_id").agg(F.count("*").alias("n")).withColumns(bloom.shape_columns(F.col("n")))
    words = {(w.run_id, w.word): w.bits for w in bloom.build(runs, sizes).collect()}
    for run, ks in keys.items():
        packed = bloom.pack(ks) + bytes(8)
        for at in range(0, len(packed) - 8, 8):
            assert words.get((run, at // 8), 0) % 2**64 == int.from_bytes(packed[at : at + 8], "little") % 2 ** min(64, 8 * (len(packed) - 8 - at))
    others = [r.randbytes(8) for _ in range(200)]
    asked = frame(spark, [(run, 0, k, b"v") for run in keys for k in [*keys[run], *others]])
    for p in bloom.probe(asked, bloom.build(runs, sizes), sizes).collect():
        assert p.may_contain == bloom.contains(bloom.pack(keys[p.run_id]), bytes(p.key))


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=12), st.one_of(st.none(), st.binary(min_size=1, max_size=40))), min_size=1, max_size=30, unique_by=lambda e: e[0]))
def test_cursor_in_both_layouts(rows):
    rows.sort()
    assert codec.decode_prefixed(codec.encode_prefixed(rows)) == rows == codec.decode(codec.encode(rows))
    for prefixed in (False, True):
        c = codec.Cursor((codec.encode_prefixed if prefixed else codec.encode)(rows), prefixed)
        for key in [rows[0][0], rows[-1][0], b"\0", b"\xff" * 13, rows[len(rows) // 2][0] + b"\0"]:
            c.seek(key)
            want = [r for r in rows if r[0] >= key]
            assert c.valid() == bool(want) and (not want or (c.key, c.value or None) == want[0])
        c.seek_first()
        seen = []
        while c.valid():
            seen.append(c.key)
            c.next()
        assert seen == [k for k, _ in rows]
        c.seek_offset(c.offsets[-1])
        assert c.key == rows[-1][0]


def test_prefixes_and_damage():
    assert codec.overlap(b"abc", b"abd") == 2 and codec.overlap(b"", b"x") == 0 and codec.overlap(b"ab", b"ab") == 2
    block = codec.encode_prefixed([(b"user-1", b"a"), (b"user-2", None)])
    assert len(block) == (2 + 2 + 6 + 2 + 1) + (2 + 2 + 1 + 2) + 6
    for bad in (b"", b"\0\0", block[:-3] + b"\xff\xff\xff", codec.encode([(b"k", b"v" * 9)])[:5] + b"\0\0\0\1"):
        with pytest.raises(codec.BlockError):
            codec.decode_prefixed(bad)
    with pytest.raises(codec.BlockError):
        codec.encode_prefixed([])


def test_batches_are_taken_in_parts():
    small = pa.record_batch({"run_id": pa.array(range(10_000)), "block": pa.array([b"x" * 4096] * 10_000)})
    parts = list(codec.slices(small))
    assert max(p.nbytes for p in parts) <= codec.AT_ONCE < small.nbytes and pa.Table.from_batches(parts).equals(pa.Table.from_batches([small]))
    large = pa.record_batch({"block": pa.array([b"x" * 3_000_000, b"y"])})
    assert [p.num_rows for p in codec.slices(large)] == [1, 1] and list(codec.slices(large.slice(0, 0))) == []


def test_large_values_in_parts(spark):
    """Some dozen parts a batch: blocks go on from one part to the next."""
    r = random.Random(5)
    rows = [(n % 2, n, b"k%04d" % n, r.randbytes(r.choice([10, 900, 60_000]))) for n in range(400)]
    held = pa.record_batch({"value": [v for *_, v in rows]})
    assert len(list(codec.slices(held))) > 5
    for prefixed in (False, True):
        blocks = codec.blocks(frame(spark, rows), prefixed=prefixed)
        back = sorted((e.run_id, bytes(e.key), bytes(e.value)) for e in codec.entries(blocks, prefixed).collect())
        assert back == sorted((r, k, v) for r, _, k, v in rows)
    most = {n: max(codec.size(b.n_entries, len(b.block) - 2 - 2 * b.n_entries) for b in codec.blocks(frame(spark, rows)).collect() if (b.n_entries > 1) == n) for n in (False, True)}
    assert most[True] <= 4096 < most[False]
