from siltstone.model import LOG, Options
from siltstone.operators.snapshot import live
from siltstone.plans.store import Store
from siltstone.queries import events_log
from siltstone.streaming.ingest import into_store, running_snapshot

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted((bytes(r.key), bytes(r.value)) for r in df.collect())


def test_stream_into_store_and_replay(spark, tmp_path):
    rows = [[(f"k{i % 4}", f"{b}-{i}", False, i) for i in range(6)] for b in range(3)]
    rows[1][2] = ("k2", None, True, 2)
    schema = "key string, value string, tombstone boolean, at int"
    store = Store(spark, str(tmp_path / "s"), Options(pending_batches=2))
    expect = {}
    for b, own in enumerate(rows):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        into_store(stream, store, "s", str(tmp_path / "c"), "at").awaitTermination()
        for k, v, gone, _ in own:
            expect.pop(k, None)
            if not gone:
                expect[k] = v
        assert pairs(store.snapshot()) == sorted((k.encode(), v.encode()) for k, v in expect.items())
    assert store.manifest.last_seq == 18 and store.manifest.streams == {"s": 2}
    # a lost checkpoint replays batch 0, which the manifest knows
    into_store(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, "s", str(tmp_path / "c2"), "at").awaitTermination()
    assert store.reload().last_seq == 18


def test_running_snapshot_equals_batch(spark, tmp_path):
    log = events_log(spark, SF)
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = running_snapshot(stream).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert pairs(spark.table("newest").where("NOT tombstone")) == pairs(live(log))
