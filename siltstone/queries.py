"""The engine's operators over the given tables, by name, and SQL that must agree with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import workload
from siltstone.functions import bloom, codec
from siltstone.model import LOG, Options, Strategy
from siltstone.operators import merge, mutations, reads
from siltstone.operators.runs import entry_bytes, flushed, frozen, frozen_by_bytes, manifest_rows
from siltstone.operators.snapshot import as_of, latest, live
from siltstone.plans import compaction
from siltstone.plans.store import Store
from siltstone.sources.manifest import Run
from siltstone.sources.scratch import scratch

BATCH = 2_500


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of users: props of an event, deleted by an error."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    deleted = F.col("event_type") == "error"
    return mutations.checked(events.select(*mutations.entry(F.concat(F.lit("user-"), F.col("user_id")), F.col("props"), F.col("event_id") + 1, deleted)))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    deleted = F.col("o_orderstatus") == "F"
    price = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    return mutations.checked(orders.select(*mutations.entry(F.concat(F.lit("cust-"), F.col("o_custkey")), price, F.col("o_orderkey") + 1, deleted)))


def shown(df: DataFrame) -> DataFrame:
    """Keys and values as text."""
    kinds = dict(df.dtypes)
    out = df.select(*(F.col(c).cast("string").alias(c) if kinds[c] == "binary" else F.col(c) for c in df.columns))
    for long, short in (("key", "k"), ("value", "v")):
        out = out.withColumnRenamed(long, short)
    return out


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flushed(frozen(events_log(spark, sf_dir), BATCH))


def split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest entries in runs of disjoint key ranges."""
    newest = latest(events_log(spark, sf_dir))
    return newest.withColumn("run_id", F.floor(F.substr(F.col("key").cast("string"), F.lit(6), F.lit(1)).cast("long") / F.lit(4)).cast("long"))


def put_delete_log(spark, d):
    return shown(events_log(spark, d))


def kv_snapshot(spark, d):
    return shown(live(events_log(spark, d)))


def kv_snapshot_orders(spark, d):
    return shown(live(orders_log(spark, d)))


def kv_get(spark, d):
    return shown(reads.get(events_log(spark, d), "user-7"))


def kv_multi_get(spark, d):
    keys = spark.range(31).select(F.concat(F.lit("user-"), F.when(F.col("id") < 30, F.col("id").cast("string")).otherwise("nope")).alias("key"))
    return shown(reads.multi_get(events_log(spark, d), keys))


def kv_multi_get_bulk(spark, d):
    """Keys by the thousand, joined by shuffle."""
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("cust-"), F.col("c_custkey") * 2).alias("key"))
    return shown(reads.multi_get(orders_log(spark, d), keys, broadcast=False))


def kv_range_scan(spark, d):
    return shown(reads.range_scan(events_log(spark, d), "user-10", "user-19").drop("seq"))


def kv_as_of(spark, d):
    return shown(as_of(events_log(spark, d), 5000))


def flush_runs(spark, d):
    return shown(runs_of(spark, d))


def run_manifest(spark, d):
    return shown(manifest_rows(runs_of(spark, d)))


def run_prune(spark, d):
    return merge.prune(manifest_rows(split_runs(spark, d)), "user-42").select("run_id")


def merge_runs(spark, d):
    return shown(merge.merge_runs(runs_of(spark, d)).drop("seq"))


def two_way_merge(spark, d):
    """The newest run over all older ones, which are merged first."""
    runs = runs_of(spark, d)
    last = F.lit(runs.agg(F.max("run_id")).first()[0])
    columns = ("key", "value", "tombstone")
    return shown(merge.two_way_merge(runs.where(F.col("run_id") == last).select(*columns), merge.merge_runs(runs.where(F.col("run_id") < last)).select(*columns)))


def concat_runs(spark, d):
    runs = split_runs(spark, d)
    return shown(merge.concat_runs(*(runs.where(F.col("run_id") == k) for k in range(3))))


def compact_full(spark, d):
    return shown(merge.merge_runs(runs_of(spark, d)).where("NOT tombstone").select("key", "value"))


def compact_stats(spark, d):
    runs = runs_of(spark, d)
    merged = merge.merge_runs(runs)
    return merged.agg(F.count("*").alias("merged"), F.count_if(~F.col("tombstone")).alias("bottom")).crossJoin(runs.agg(F.count("*").alias("rows_in")))  # one row each


def level_overlap(spark, d):
    return merge.overlaps(manifest_rows(runs_of(spark, d)))


def level_check(spark, d):
    return merge.level_check(manifest_rows(split_runs(spark, d)).withColumn("level", F.lit(1)))


def level_seek(spark, d):
    """From a key on, over runs of disjoint ranges; runs that end before it aren't read."""
    runs = split_runs(spark, d)
    return shown(reads.seek(runs, "user-42").select("key", "value", "seq", "tombstone", "run_id"))


def memtable_size(spark, d):
    return runs_of(spark, d).groupBy("run_id").agg(F.sum(entry_bytes()).alias("bytes"))


def freeze_by_bytes(spark, d):
    """Runs as a memtable of 1,000 bytes would cut them."""
    runs = frozen_by_bytes(events_log(spark, d), 1000)
    return runs.groupBy("run_id").agg(F.count("*").alias("mutations"), F.max("seq").alias("last_seq"))


def bloom_params(spark, d):
    sizes = runs_of(spark, d).groupBy("run_id").agg(F.count("*").alias("n"))
    return sizes.withColumns(bloom.shape_columns(F.col("n")))


def bloom_probe(spark, d):
    """Every key against the run that holds it, and as many keys that no run holds: of these, few may seem to be there."""
    runs = runs_of(spark, d)
    sizes = runs.groupBy("run_id").agg(F.count("*").alias("n")).withColumns(bloom.shape_columns(F.col("n")))
    filters = bloom.build(runs, sizes)
    absent = bloom.probe(runs.select("run_id", F.concat("key", F.lit(b"?")).alias("key")), filters, sizes)
    told = bloom.probe(runs, filters, sizes).withColumn("held", F.lit(True)).union(absent.withColumn("held", F.lit(False)))
    n = lambda held: F.count_if(F.col("held") == held)
    return told.groupBy("run_id").agg(
        n(True).alias("held"), F.count_if(F.col("held") & ~F.col("may_contain")).alias("missed"), n(False).alias("absent"), (F.count_if(~F.col("held") & F.col("may_contain")) <= 5 + 0.03 * n(False)).alias("few_false")
    )


def block_index(spark, d):
    return shown(codec.blocks(runs_of(spark, d)).drop("block", "crc"))


def block_roundtrip(spark, d):
    return shown(codec.entries(codec.blocks(runs_of(spark, d))).drop("block_id"))


def block_prefix_roundtrip(spark, d):
    """Blocks whose keys are kept as what differs from the block's first one."""
    return shown(codec.entries(codec.blocks(runs_of(spark, d), prefixed=True), prefixed=True).drop("block_id"))


def block_large_values(spark, d):
    """Whole documents as values: a text beyond the block size has a block of its own."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    log = mutations.puts(docs.where("length(text) > 0").withColumn("id", F.col("doc_id").cast("string")), "id", "text", F.col("doc_id") + 1).withColumn("run_id", F.pmod("seq", F.lit(8)))
    back = codec.entries(codec.blocks(log))
    return back.select(F.col("key").cast("string").alias("k"), F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("sha256"))


def _scratch_store(spark: SparkSession, **options) -> Store:
    """A store of its own for one query, below the shared folder if the cluster names one."""
    return Store(spark, scratch(spark, "store"), Options(**options))


def _filled(spark: SparkSession, d: str, batches: int, **options) -> Store:
    """The events log written in batches of equal ranges of seq, each flushed."""
    store = _scratch_store(spark, pending_batches=1, **options)
    log = events_log(spark, d)
    last = log.agg(F.max("seq")).first()[0] or 0
    step = -(-last // batches)
    for k in range(batches):
        store.append(log.where((F.col("seq") > k * step) & (F.col("seq") <= (k + 1) * step)))
    return store


def store_snapshot(spark, d):
    """Through log, runs and manifest, opened again before reading."""
    return shown(_filled(spark, d, 4).reopen().snapshot())


def store_full_compaction(spark, d):
    store = _filled(spark, d, 4)
    store.compact(Strategy.FULL)
    return shown(store.reopen().log())


def store_tiered_compaction(spark, d):
    store = _filled(spark, d, 6, strategy=Strategy.TIERED, tier_runs=3, tier_factor=4.0)
    return shown(store.reopen().snapshot())


def store_leveled_compaction(spark, d):
    store = _filled(spark, d, 6, strategy=Strategy.LEVELED, level0_runs=2, run_bytes=2_000, level1_bytes=4_000, level_factor=2)
    return shown(store.reopen().snapshot())


def store_ingest(spark, d):
    """Rows without seq, numbered by their order: 1, 2, 3, ..."""
    store = _scratch_store(spark, pending_batches=100)
    events = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("user-"), F.col("user_id")).alias("key"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("tombstone"), "event_id")
    store.ingest(events.withColumn("value", F.when(~F.col("tombstone"), F.col("value"))), "event_id")
    return shown(store.log())


def store_all_deleted(spark, d):
    """Every key put and then deleted, and merged to the bottom: no run is left, and the store still takes writes."""
    store = _filled(spark, d, 2, strategy=Strategy.LEVELED, level0_runs=1)
    gone = store.snapshot().select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("tombstone"))
    store.ingest(gone, "key")
    store.compact(Strategy.FULL)
    kept = store.reopen()
    left = kept.log().count()
    return kept.spark.createDataFrame([(left, len(kept.manifest.runs))], "entries long, runs long")


def stream_snapshot(spark, d):
    """The log as a stream of files into a store, numbered again in order of seq."""
    from siltstone.streaming.ingest import into_store

    store = _scratch_store(spark, pending_batches=2)
    staged, log = f"{store.files.root}-source", events_log(spark, d)
    last = log.agg(F.max("seq")).first()[0] or 0
    for k in range(3):  # one after the other: the source takes files by age
        own = log.where((F.col("seq") > last * k // 3) & (F.col("seq") <= last * (k + 1) // 3))
        own.coalesce(1).write.mode("append").parquet(staged)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(staged)
    into_store(stream, store, "files", f"{store.files.root}-checkpoint", "seq").awaitTermination()
    return shown(store.snapshot())


def tiered_plan(spark, d):
    """Runs of 2,500 mutations, by size: the first plan of size-tiered compaction."""
    rows = manifest_rows(runs_of(spark, d)).orderBy("run_id").collect()
    runs = [Run(r["run_id"], 0, "", r["n_rows"], r["n_tombstones"], r["bytes"], bytes(r["first_key"]), bytes(r["last_key"]), r["min_seq"], r["max_seq"]) for r in rows]
    task = compaction.tiered(runs, 2, 2.0)
    return spark.createDataFrame([(k, task.drop_tombstones) for k in task.inputs] if task else [], "run_id long, drop_tombstones boolean")


def bench_workload(spark, d):
    """The benchmark's puts and gets: all keys distinct, all reads found."""
    w = workload.Workload()
    log = workload.log(spark, w)
    keys = workload.asked(spark, w)
    answers = reads.multi_get(log, keys).withColumnRenamed("key", "k")
    found = keys.join(answers.where("status = 'FOUND'"), keys["key"] == F.col("k")).agg(F.count("*").alias("found"))
    return log.agg(F.count_distinct("key").alias("keys"), F.min(F.octet_length("key")).alias("key_bytes"), F.max(F.octet_length("value")).alias("value_bytes")).crossJoin(found)


QUERIES = {
    f.__name__: f
    for f in (
        put_delete_log, kv_snapshot, kv_snapshot_orders, kv_get, kv_multi_get, kv_multi_get_bulk, kv_range_scan, kv_as_of, flush_runs,
        run_manifest, run_prune, merge_runs, two_way_merge, concat_runs, compact_full, compact_stats, level_overlap, level_check,
        level_seek, memtable_size, freeze_by_bytes, bloom_params, bloom_probe, block_index, block_roundtrip, block_prefix_roundtrip, block_large_values, store_snapshot,
        store_full_compaction, store_tiered_compaction, store_leveled_compaction, store_ingest, store_all_deleted, stream_snapshot, tiered_plan, bench_workload,
    )
}

_LOG = """WITH L AS (
  SELECT 'user-' || user_id AS k, CASE WHEN event_type <> 'error' THEN props END AS v, event_id + 1 AS seq, event_type = 'error' AS tombstone FROM events
), latest AS (
  SELECT k, v, seq, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS nr FROM L) WHERE nr = 1
), runs AS (
  SELECT run_id, k, v, seq, tombstone FROM (
    SELECT *, (seq - 1) // 2500 AS run_id, row_number() OVER (PARTITION BY (seq - 1) // 2500, k ORDER BY seq DESC) AS nr FROM L) WHERE nr = 1
), sized AS (
  SELECT *, strlen(k) + coalesce(strlen(v), 0) AS size FROM runs
), manifest AS (
  SELECT run_id, count(*) AS n_rows, count(*) FILTER (tombstone) AS n_tombstones, sum(size)::BIGINT AS bytes,
    min(k) AS first_key, max(k) AS last_key, min(seq) AS min_seq, max(seq) AS max_seq FROM sized GROUP BY run_id
), merged AS (
  SELECT k, v, tombstone, run_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run_id DESC) AS nr FROM runs) WHERE nr = 1
), split AS (
  SELECT *, substr(k, 6, 1)::BIGINT // 4 AS run_id FROM latest
)
"""
_RECURSIVE = _LOG.replace("WITH L", "WITH RECURSIVE L", 1).rstrip()
_FREEZE = """, m AS MATERIALIZED (
  SELECT seq, size, lag(seq) OVER w AS p, lag(size) OVER w AS p_size FROM (SELECT k, seq, strlen(k) + coalesce(strlen(v), 0) AS size FROM L) WINDOW w AS (PARTITION BY k ORDER BY seq)
), cuts AS (
  SELECT -1::BIGINT AS run_id, -1::BIGINT AS first, 0::BIGINT AS last
  UNION ALL
  SELECT run_id + 1, last, min(seq) FILTER (total >= 1000) FROM (
    SELECT c.run_id, c.last, m.seq, sum(m.size - CASE WHEN m.p > c.last THEN m.p_size ELSE 0 END) OVER (ORDER BY m.seq) AS total FROM cuts c JOIN m ON m.seq > c.last
  ) GROUP BY run_id, last
)
SELECT c.run_id, count(*) AS mutations, max(m.seq) AS last_seq FROM cuts c JOIN m ON m.seq > c.first AND m.seq <= coalesce(c.last, 9223372036854775807) WHERE c.run_id >= 0 GROUP BY c.run_id
"""
_BLOCKS = """, e AS MATERIALIZED (
  SELECT run_id, k, row_number() OVER (PARTITION BY run_id ORDER BY k) AS nr, 2 + n + 1 + (n > 127)::INT + (n > 16383)::INT + o + 1 + (o > 127)::INT + (o > 16383)::INT AS more
  FROM (SELECT run_id, k, strlen(k) AS n, coalesce(strlen(v), 0) AS o FROM runs)
), b AS (
  SELECT DISTINCT run_id, -1::INT AS block_id, 0::BIGINT AS first, 0::BIGINT AS last FROM e
  UNION ALL
  SELECT run_id, block_id + 1, last, greatest(last + 1, coalesce(max(nr) FILTER (total + 2 <= 4096), 0)) FROM (
    SELECT b.run_id, b.block_id, b.last, e.nr, sum(e.more) OVER (PARTITION BY b.run_id ORDER BY e.nr) AS total FROM b JOIN e ON e.run_id = b.run_id AND e.nr > b.last
  ) GROUP BY run_id, block_id, last
)
SELECT b.run_id, b.block_id, count(*)::INT AS n_entries, min(e.k) AS first_key, max(e.k) AS last_key FROM b JOIN e ON e.run_id = b.run_id AND e.nr > b.first AND e.nr <= b.last WHERE b.block_id >= 0 GROUP BY ALL
"""
_TIERED = """, aged AS (
  SELECT run_id, greatest(bytes, 1) AS size, row_number() OVER (ORDER BY max_seq, run_id) AS nr FROM manifest
), stretch AS (
  SELECT a.nr AS first, e.nr AS last, max(e.size) OVER w <= 2 * min(e.size) OVER w AS ok FROM aged a JOIN aged e ON e.nr >= a.nr WINDOW w AS (PARTITION BY a.nr ORDER BY e.nr)
), chosen AS (
  SELECT first, max(last) AS last FROM stretch WHERE ok GROUP BY first HAVING max(last) > first ORDER BY first LIMIT 1
)
SELECT run_id, first = 1 AS drop_tombstones FROM aged JOIN chosen ON nr BETWEEN first AND last
"""
_ORDERS = """WITH L AS (
  SELECT 'cust-' || o_custkey AS k, CASE WHEN o_orderstatus <> 'F' THEN round(o_totalprice * 100)::BIGINT::VARCHAR END AS v, o_orderkey + 1 AS seq, o_orderstatus = 'F' AS tombstone FROM orders
), latest AS (
  SELECT k, v, seq, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS nr FROM L) WHERE nr = 1
)
"""
_SNAPSHOT = "SELECT k, v, seq FROM latest WHERE NOT tombstone"
_STATUS = "SELECT r.k, CASE WHEN w.k IS NULL THEN 'ABSENT' WHEN w.tombstone THEN 'DELETED' ELSE 'FOUND' END AS status, w.v FROM req r LEFT JOIN latest w ON r.k = w.k"

ORACLES = {
    "put_delete_log": _LOG + "SELECT k, v, seq, tombstone FROM L",
    "kv_snapshot": _LOG + _SNAPSHOT,
    "kv_snapshot_orders": _ORDERS + _SNAPSHOT,
    "kv_get": _LOG + _SNAPSHOT + " AND k = 'user-7'",
    "kv_multi_get": _LOG.rstrip() + ", req AS (SELECT 'user-' || i AS k FROM range(30) t(i) UNION ALL SELECT 'user-nope') " + _STATUS,
    "kv_multi_get_bulk": _ORDERS.rstrip() + ", req AS (SELECT DISTINCT 'cust-' || (c_custkey * 2) AS k FROM customer) " + _STATUS,
    "kv_range_scan": _LOG + "SELECT k, v FROM latest WHERE NOT tombstone AND k BETWEEN 'user-10' AND 'user-19'",
    "kv_as_of": _LOG + "SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS nr FROM L WHERE seq <= 5000) WHERE nr = 1 AND NOT tombstone",
    "flush_runs": _LOG + "SELECT run_id, k, v, seq, tombstone FROM runs",
    "run_manifest": _LOG + "SELECT * FROM manifest",
    "run_prune": _LOG + "SELECT run_id FROM split GROUP BY run_id HAVING min(k) <= 'user-42' AND max(k) >= 'user-42'",
    "merge_runs": _LOG + "SELECT k, v, tombstone, run_id FROM merged",
    "two_way_merge": _LOG + "SELECT k, v, tombstone FROM merged",
    "concat_runs": _LOG + "SELECT k, v, seq, tombstone, run_id FROM split",
    "compact_full": _LOG + "SELECT k, v FROM merged WHERE NOT tombstone",
    "compact_stats": _LOG + "SELECT (SELECT count(*) FROM runs) AS rows_in, count(*) AS merged, count(*) FILTER (NOT tombstone) AS bottom FROM merged",
    "level_overlap": _LOG + "SELECT a.run_id AS a, b.run_id AS b FROM manifest a JOIN manifest b ON a.run_id < b.run_id AND a.first_key <= b.last_key AND b.first_key <= a.last_key",
    "level_check": _LOG + "SELECT 1 AS level, run_id, coalesce(last_key < lead(first_key) OVER (ORDER BY first_key), true) AS ok FROM (SELECT run_id, min(k) AS first_key, max(k) AS last_key FROM split GROUP BY run_id)",
    "level_seek": _LOG + "SELECT k, v, seq, tombstone, run_id FROM split WHERE k >= 'user-42'",
    "memtable_size": _LOG + "SELECT run_id, sum(size)::BIGINT AS bytes FROM sized GROUP BY run_id",
    "freeze_by_bytes": _RECURSIVE + _FREEZE,
    "block_index": _RECURSIVE + _BLOCKS,
    "tiered_plan": _LOG.rstrip() + _TIERED,
    "bloom_params": _LOG + "SELECT run_id, count(*) AS n, 10::BIGINT AS bits_per_key, 7 AS probes, (ceil(greatest(64, 10 * count(*)) / 8.0) * 8)::BIGINT AS bits FROM runs GROUP BY run_id",
    "bloom_probe": _LOG + "SELECT run_id, count(*) AS held, 0::BIGINT AS missed, count(*) AS absent, true AS few_false FROM runs GROUP BY run_id",
    "block_roundtrip": _LOG + "SELECT run_id, k, v, tombstone FROM runs",
    "block_prefix_roundtrip": _LOG + "SELECT run_id, k, v, tombstone FROM runs",
    "block_large_values": "SELECT doc_id::VARCHAR AS k, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents WHERE length(text) > 0",
    "store_snapshot": _LOG + _SNAPSHOT,
    "store_full_compaction": _LOG + "SELECT k, v, seq, tombstone FROM latest WHERE NOT tombstone",
    "store_tiered_compaction": _LOG + _SNAPSHOT,
    "store_leveled_compaction": _LOG + _SNAPSHOT,
    "store_ingest": _LOG + "SELECT k, v, row_number() OVER (ORDER BY seq) AS seq, tombstone FROM L",
    "store_all_deleted": "SELECT 0::BIGINT AS entries, 0::BIGINT AS runs",
    "stream_snapshot": _LOG + _SNAPSHOT,
    "bench_workload": "SELECT 1000000::BIGINT AS keys, 16 AS key_bytes, 64 AS value_bytes, 500000::BIGINT AS found",
}
