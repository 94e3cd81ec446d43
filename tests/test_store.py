"""The store against a dict."""

import random
import time

import pytest

from siltstone import cli, workload
from siltstone.model import ABSENT, DELETED, FOUND, Options, Strategy
from siltstone.operators import merge, mutations, reads
from siltstone.operators.runs import frozen_by_bytes
from siltstone.operators.snapshot import as_of, latest, live
from siltstone.plans import compaction
from siltstone.plans.store import Store
from siltstone.sources.manifest import Catalog, Conflict, Manifest, Run


def contents(store, seq=None):
    return {bytes(r.key): bytes(r.value) for r in store.snapshot(seq).collect()}


def keys(spark, *values):
    return spark.createDataFrame([(bytearray(v),) for v in values], "key binary")


def test_statuses_and_order(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=3))
    assert s.status("a") == (ABSENT, None)
    assert s.put("a", "1") == 1 and s.write([("a", "2"), (b"\xff\x01", b"\0"), ("b", "3"), ("ab", "4")]) == 5
    assert s.delete("b") == 6 and s.delete("never") == 7  # the third batch flushes, the fourth waits
    assert len(s.manifest.runs) == 1 and len(s.manifest.batches) == 1
    assert s.status("a") == (FOUND, b"2") and s.status("b") == (DELETED, None) and s.status("never") == (DELETED, None)
    assert s.get("b") is None and s.get("nope") is None
    got = {bytes(r.key): (r.status, r.value and bytes(r.value)) for r in s.multi_get(keys(spark, b"a", b"b", b"zz", b"a")).collect()}
    assert got == {b"a": (FOUND, b"2"), b"b": (DELETED, None), b"zz": (ABSENT, None)}
    scan = lambda *x: [bytes(r.key) for r in s.range_scan(*x).collect()]
    assert scan("a", "b") == [b"a", b"ab"] and scan("ab", "ab") == [b"ab"] and scan("b", "a") == [] and scan("aa", b"\xff\xff") == [b"ab", b"\xff\x01"]
    assert scan("a", b"\xff\xff", 1) == [b"a"]
    assert s.multi_get(keys(spark)).count() == 0


@pytest.mark.parametrize("bad", [("", "x"), ("k", ""), ("", None)])
def test_empty_is_refused_and_changes_nothing(spark, tmp_path, bad):
    s = Store(spark, str(tmp_path / "s"))
    s.put("k", "v")
    before = s.manifest
    with pytest.raises(ValueError):
        s.write([("ok", "1"), bad])
    row = [(bytearray(bad[0].encode()), None if bad[1] is None else bytearray(bad[1].encode()), 9, bad[1] is None)]
    log = spark.createDataFrame(row, "key binary, value binary, seq long, tombstone boolean")
    with pytest.raises(Exception, match="must not be empty"):
        s.append(log)
    assert mutations.refused(log).count() == 1
    assert s.manifest == before == s.reload()


def test_reopen_goes_on(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store(spark, path, Options(pending_batches=2)) as s:
        s.put("a", "1")
        s.put("b", "1")
        s.put("c", "1")
    with pytest.raises(RuntimeError):
        s.put("d", "1")
    again = Store(spark, path)
    assert contents(again) == {b"a": b"1", b"b": b"1", b"c": b"1"}
    assert [r.run_id for r in again.manifest.runs] == [1, 2] and again.put("a", "2") == 4
    lost = Store(spark, path)  # nobody closed it: the log has it
    assert contents(lost)[b"a"] == b"2" and lost.flush()[0].run_id == 3 and lost.flush() == []


def test_second_writer_is_told(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    a.put("k", "a")
    with pytest.raises(Conflict):
        b.put("k", "b")
    b.reload()
    assert b.put("k", "b") == 2 and contents(b) == {b"k": b"b"}


def test_deleted_stays_deleted_through_merges(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=1))
    s.put("k", "old")
    s.delete("k")
    s.put("other", "x")
    older, newer = s.manifest.runs[0], s.manifest.runs[1]
    s.merge(compaction.Task((newer.run_id, s.manifest.runs[2].run_id), 0, False))
    assert s.status("k") == (DELETED, None)
    s.compact(Strategy.FULL)
    assert s.status("k") == (ABSENT, None) and contents(s) == {b"other": b"x"}
    assert all(r.level == 1 and not r.n_tombstones for r in s.manifest.runs) and s.compact(Strategy.FULL) == []
    with pytest.raises(ValueError):
        s.merge(compaction.Task((older.run_id,), 1, True))


STORES = {
    "none": Options(pending_batches=2),
    "tiered": Options(pending_batches=1, strategy=Strategy.TIERED, tier_runs=2, tier_factor=3),
    "leveled": Options(pending_batches=1, strategy=Strategy.LEVELED, level0_runs=2, run_bytes=60, level1_bytes=120, level_factor=2, bloom_filter=False),
}


@pytest.mark.parametrize("kind", STORES)
def test_random_sequences_against_a_dict(spark, tmp_path, kind):
    r = random.Random(kind)
    s, model = Store(spark, str(tmp_path / "s"), STORES[kind]), {}
    pool = [b"k%d" % k for k in range(12)] + [b"\x80", b"\xff\x01", b"a", b"ab"]
    for _ in range(7):
        batch = [(r.choice(pool), None if r.random() < 0.3 else r.randbytes(r.randrange(1, 12))) for _ in range(r.randrange(1, 15))]
        s.write(batch)
        for k, v in batch:
            model.pop(k, None)
            if v is not None:
                model[k] = v
        assert contents(s) == model
    low, high = sorted(r.sample(pool, 2))
    for level in {x.level for x in s.manifest.runs}:
        found = [(bytes(x.key), -x.seq) for x in s.level_scan(level, low).collect()]
        assert found == sorted(found) and all(k >= low for k, _ in found)
    assert [(bytes(x.key), bytes(x.value)) for x in s.range_scan(low, high).collect()] == sorted((k, v) for k, v in model.items() if low <= k <= high)
    for level in {x.level for x in s.manifest.runs} - {0}:
        assert compaction.disjoint([x for x in s.manifest.runs if x.level == level])
    assert contents(s.reopen()) == model
    s.compact(Strategy.FULL)
    assert contents(s) == model and sum(x.n_rows for x in s.manifest.runs) + sum(b.n_rows for b in s.manifest.batches) >= len(model)


def test_ingest_numbers_rows_in_order(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=100))
    s.put("k0", "first")
    rows = [(f"k{(i * 7) % 5}", f"v{i}", False, (i * 37) % 100) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, value string, tombstone boolean, at int").repartition(7)
    assert s.ingest(df, "at") == 101
    log = [(r.seq, bytes(r.key).decode(), bytes(r.value).decode()) for r in s.log().orderBy("seq").collect()]
    assert log == [(1, "k0", "first"), *((k + 2, *r[:2]) for k, r in enumerate(sorted(rows, key=lambda r: r[3])))]
    assert s.files.names(f"{s.files.root}/staged") == []
    with pytest.raises(ValueError):
        s.ingest(df)
    with pytest.raises(ValueError):
        s.append(s.log())


def run(k, level=0, size=10, first=b"a", last=b"z", seq=None):
    return Run(k, level, "", 1, 0, size, first, last, seq or k, seq or k)


def test_tiered_takes_neighbours_only():
    assert compaction.tiered([run(1, size=100), run(2), run(3), run(4)], 3, 2.0) == compaction.Task((2, 3, 4), 0, False)
    assert compaction.tiered([run(1), run(2, size=100), run(3), run(4)], 3, 2.0) is None
    assert compaction.tiered([run(2), run(1), run(3)], 3, 2.0) == compaction.Task((1, 2, 3), 0, True)


def test_leveled_plans():
    o = Options(level0_runs=2, level1_bytes=25, level_factor=10)
    assert compaction.leveled([run(1)], o) is None
    assert compaction.leveled([run(1, first=b"a", last=b"c"), run(2, first=b"b", last=b"d"), run(3, 1, first=b"d", last=b"e"), run(4, 1, first=b"f", last=b"g")], o) == compaction.Task((1, 2, 3), 1, True)
    deep = [run(1, 1, first=b"a", last=b"b"), run(2, 1, first=b"c", last=b"d"), run(3, 1, first=b"e", last=b"f"), run(4, 2, first=b"b", last=b"c"), run(5, 3)]
    assert compaction.leveled(deep, o) == compaction.Task((1, 4), 2, False)


def test_manifest_as_json(spark, tmp_path):
    m = Manifest(3, 9, 100, (run(1, first=b"\xff\0"),), (), {"s": 4})
    assert Manifest.from_json(m.to_json()) == m
    assert m.frame(spark).first().first_key == bytearray(b"\xff\0")
    assert [bool(m.pruned(*x)) for x in ((b"a", b"b"), (b"\xff", b"\xff\xff"))] == [False, False]


def test_old_versions_go(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=100))
    for k in range(8):
        s.put("k", str(k))
    assert s.reload().version == 8


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), v and bytearray(v), s, v is None) for s, k, v in rows], "key binary, value binary, seq long, tombstone boolean")


def test_frames_without_a_store(spark):
    rows = [(1, b"a", b"1"), (2, b"b", b"1"), (3, b"a", None), (4, b"c", b"2"), (5, b"a", b"3"), (6, b"b", None)]
    log = frame(spark, rows)
    pairs = lambda df: sorted((bytes(r.key), r.value and bytes(r.value)) for r in df.collect())
    assert pairs(live(log)) == [(b"a", b"3"), (b"c", b"2")] and pairs(as_of(log, 4)) == [(b"b", b"1"), (b"c", b"2")]
    assert pairs(latest(log)) == [(b"a", b"3"), (b"b", None), (b"c", b"2")]
    assert pairs(reads.get(log, "b")) == [] and pairs(reads.get(log, "c")) == [(b"c", b"2")]
    older, newer = log.where("seq < 4"), log.where("seq >= 4")
    assert pairs(merge.two_way_merge(latest(newer), latest(older))) == pairs(latest(log))
    assert log.where("key = X'61'")._jdf.queryExecution().toString()


def test_freeze_by_bytes_is_a_fold(spark):
    r = random.Random(4)
    rows = [(s, b"k%d" % r.randrange(6), None if r.random() < 0.2 else b"v" * r.randrange(1, 9)) for s in range(1, 80)]
    want, number, held = [], 0, {}
    for _, k, v in rows:
        want.append(number)
        held[k] = len(k) + len(v or b"")
        if sum(held.values()) >= 30:
            number, held = number + 1, {}
    got = frozen_by_bytes(frame(spark, rows).repartition(5), 30).orderBy("seq").collect()
    assert [x.run_id for x in got] == want


def test_level_check_and_overlap(spark):
    m = Manifest(runs=(run(1, 1, first=b"a", last=b"c"), run(2, 1, first=b"d", last=b"f"), run(3, 2, first=b"a", last=b"d"), run(4, 2, first=b"d", last=b"e"))).frame(spark)
    assert {r.run_id: r.ok for r in merge.level_check(m).collect()} == {1: True, 2: True, 3: False, 4: True}
    assert sorted((r.a, r.b) for r in merge.overlaps(m).collect()) == [(1, 3), (2, 3), (2, 4), (3, 4)]
    assert sorted(r.run_id for r in merge.prune(m, b"d").collect()) == [2, 3, 4]


def test_shell(spark, tmp_path):
    s, said = Store(spark, str(tmp_path / "s")), []
    lines = ["put a 'x y'", "get a", "", "get b", "delete a", "get a", "put a ''", "what", "put b 1", "scan a z", "flush", "runs", "compact full", "exit", "get b"]
    cli.loop(s, lines, said.append)
    assert said[:4] == ["ok 1", "x y", "the key does not exist", "ok 2"] and said[4] == "the key does not exist"
    assert said[5].startswith("error") and said[6].startswith("error") and said[7:10] == ["ok 3", "b = 1", "1 runs written"]
    assert len(said) == 12
    cli.loop(s, [], said.append)  # the end of input ends it


def test_workload(spark, tmp_path):
    r = workload.run(Store(spark, str(tmp_path / "s")), workload.Workload(keys=3000))
    assert (r.writes, r.reads, r.found) == (3000, 1500, 1500) and r.writes_per_second > 0 < r.reads_per_second


def test_every_key_deleted(spark, tmp_path):
    for strategy in (Strategy.FULL, Strategy.LEVELED):
        s = Store(spark, str(tmp_path / strategy.value), Options(pending_batches=1, strategy=strategy, level0_runs=1))
        s.put("k", "v")
        s.delete("k")
        assert contents(s) == {} and s.manifest.runs == () and s.status("k") == (ABSENT, None)
        s.put("k", "w")
        assert contents(s.reopen()) == {b"k": b"w"}


def test_frames_outlive_flush_and_merge(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=9))
    s.put("a", "1")
    s.put("b", "1")
    before = s.snapshot()
    s.flush()
    s.delete("a")
    s.flush()
    between = s.snapshot()
    s.compact(Strategy.FULL)
    seen = lambda df: {bytes(r.key) for r in df.collect()}
    assert seen(before) == {b"a", b"b"} and seen(between) == {b"b"} == seen(s.snapshot())


def test_versions_and_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=2, keep_versions=2))
    for k in range(24):
        s.put(f"k{k % 5}", str(k))
    s.compact(Strategy.FULL)
    files = lambda: {f"{d}/{n}" for d in ("log", "runs", "staged") for n in s.files.names(f"{s.files.root}/{d}")}
    assert s.manifest.version == 37 and len(s.manifest.runs) == 1
    assert Catalog(s.files).load() == s.manifest and min(s.catalog._numbers()) == 21
    assert Catalog(s.files).load(36).runs != s.manifest.runs
    s._log(s.manifest.runs).write.parquet(f"{s.files.root}/runs/{'0' * 32}")  # what a writer that failed leaves
    assert s.vacuum() and len(files()) == 1
    assert contents(s.reopen()) == {f"k{k % 5}".encode(): str(k).encode() for k in range(19, 24)}
    s.put("a", "b")
    assert contents(s.reopen())[b"a"] == b"b"


def test_a_late_batch_takes_no_number_back(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=9))
    row = lambda seq, v: spark.createDataFrame([(bytearray(b"k"), bytearray(v), seq, False)], "key binary, value binary, seq long, tombstone boolean")
    s.append(row(100, b"a"))
    s._append(row(1, b"z"))
    assert s.put("k", "new") == 101 and s.get("k") == b"new"


def test_block_index_of_all_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=1))
    assert s.block_index().count() == 0
    for k in range(3):
        s.write([(f"k{i}", "v" * 100) for i in range(50 + k)])
    got = {}
    for r in s.block_index(1000).collect():
        got[r.run_id] = got.get(r.run_id, 0) + r.n_entries
    assert got == {1: 50, 2: 51, 3: 52}


def test_flush_and_merge_in_the_background(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=2, flush_seconds=0.5, strategy=Strategy.FULL))
    s.background(0.05)
    for k in range(6):
        s.put(f"k{k % 4}", str(k))
    until = time.monotonic() + 60
    while (s.manifest.batches or len(s.manifest.runs) != 1) and time.monotonic() < until:
        time.sleep(0.1)
    assert s.failure is None and not s.manifest.batches and len(s.manifest.runs) == 1
    assert contents(s) == {b"k0": b"4", b"k1": b"5", b"k2": b"2", b"k3": b"3"}
    s.delete("k0")
    s.close()
    assert contents(s.reopen()) == {b"k1": b"5", b"k2": b"2", b"k3": b"3"}
    assert s.manifest.last_seq == 7


def test_flush_by_age_at_the_next_write(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=99, flush_seconds=0.0))
    s.put("a", "1")
    assert len(s.manifest.runs) == 1 and not s.manifest.batches


def test_a_failure_in_the_background_is_raised_by_close(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(pending_batches=1))

    def broken():
        raise OSError("no room")

    s.flush = broken
    s.background(0.01)
    s.put("a", "1") if s._in_background() else None
    s._thread.join(30)
    with pytest.raises(OSError):
        s.close()
    assert contents(Store(spark, s.files.root)) == {b"a": b"1"}


def test_a_level_goes_down_at_once(spark, tmp_path):
    o = Options(level0_runs=2, level1_bytes=25, level_factor=2)
    many = [run(k, 1, first=b"%03d" % k, last=b"%03dz" % k) for k in range(1, 101)]
    assert compaction.leveled(many, o) == compaction.Task(tuple(range(1, 99)), 2, True)
    s = Store(spark, str(tmp_path / "s"), Options(strategy=Strategy.LEVELED, level0_runs=2, run_bytes=100, level1_bytes=200, level_factor=2))
    held = {}
    for batch in range(4):
        rows = [(b"k%04d" % k, None if (k + batch) % 7 == 0 else b"v%d-%d" % (k, batch)) for k in range(batch, 400, 2)]
        s.append(frame(spark, [(s.manifest.last_seq + 1 + n, k, v) for n, (k, v) in enumerate(rows)]))
        held |= dict(rows)
    s.flush()
    assert contents(s.reopen()) == {k: v for k, v in held.items() if v is not None}
    assert len(s.manifest.runs) > 30 and s.manifest.version < 20  # some merges for each flush, not one for each run
    for level in range(1, 5):
        own = [r for r in s.manifest.runs if r.level == level]
        assert compaction.disjoint(own) and (level == 4 or sum(r.bytes for r in own) <= 200 * 2 ** (level - 1))
    assert max(r.bytes for r in s.manifest.runs) < 300


@pytest.mark.parametrize("most", [1, 30, 200, 100_000])
def test_freeze_by_bytes_in_stretches(spark, most):
    """Runs go on from one stretch to the next, and over several; one task never has the whole log."""
    r = random.Random(most)
    rows = [(s, b"k%d" % r.randrange(40), None if r.random() < 0.2 else b"v" * r.randrange(1, 9)) for s in range(1, 300)]
    want, number, held = {}, 0, {}
    for s, k, v in rows:
        want[s] = (number, k, v)
        held[k] = len(k) + len(v or b"")
        if sum(held.values()) >= most:
            number, held = number + 1, {}
    got = frozen_by_bytes(frame(spark, rows).repartition(5), most, stretch=25)
    assert got.columns == ["key", "value", "seq", "tombstone", "run_id"]
    seen = got.collect()
    assert len(seen) == len(rows) and {x.seq: (x.run_id, bytes(x.key), x.value and bytes(x.value)) for x in seen} == want
    assert all(x.tombstone == (x.value is None) for x in seen)
    folders = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert len(folders) == 12
