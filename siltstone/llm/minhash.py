"""Near-duplicates: MinHash with tensored banding, and every link confirmed on whole shingle sets.

Each set has two small collections of `tables` partial keys, each of `width` minhashes; a table key is one
of the first with one of the second. So tables**2 tables of 2 * width minhashes cost only 2 * tables * width
minhashes. With 14 and 3, sets of similarity 0.8 share a table but for one pair in ten thousand, more
similar ones practically always. A partial key that only one set has can be in no shared table and goes
before keys are combined.

Equal sets count once. In every table key all sets are compared with the smallest id there, its hub. Where a
key still holds several components, its sets fall into clusters (the smallest hub within two steps), and a
cluster is compared in blocks of bounded size, two blocks a task: texts are sent once for each block of their
cluster, pairs never leave a task, and of links only those that join components. Pairs that share a key but
no cluster are compared one by one. Which pairs get compared therefore never depends on the size of a group.

Null ids are linked with nothing and have no component; rows that share an id are one document. Null and empty
texts have an empty set, linked with nothing; very long texts are sets like others. Ties have no say: the
smallest id names a component. Columns but doc_id and text play no part. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.tables import table, written
from siltstone.llm.text import U, mix, release, shared, shingle_sets, words

#: Documents compared with one hub in one stretch; more are split.
STRETCH = 256
#: Shingles of one block of a cluster, on average.
A_BLOCK = 1 << 20


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 64, n, U), r.integers(0, 1 << 63, n, U) * U(2) + U(1)


def partial_keys(sets: np.ndarray, at: np.ndarray, tables: int, width: int, seed: int) -> np.ndarray:
    """One row of `tables` keys for each set that isn't empty."""
    first = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(first), tables), U)
    if len(first):
        flip, times = _functions(tables * width, seed)
        for k in range(tables):
            key = np.full(len(first), seed * tables + k, U)
            for j in range(k * width, (k + 1) * width):
                key = mix(key ^ np.minimum.reduceat((sets ^ flip[j]) * times[j], first))
            out[:, k] = key
    return out


def sketch(docs: DataFrame, shingle: int, tables: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, a, b): c1 and c2 tell the set, a and b are its partial keys."""
    schema = "doc_id long, n_shingles long, c1 long, c2 long, a array<long>, b array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1)):
                sets, at = shingle_sets(w, shingle)
                size = np.diff(at)
                some, first = size > 0, at[:-1][size > 0]
                columns = [ids.slice(w.lo, w.hi - w.lo), pa.array(size)]
                for values in (sets, mix(sets ^ U(0x2545F4914F6CDD1D))):
                    c = np.zeros(len(size), U)
                    if len(first):
                        c[some] = np.add.reduceat(values, first)
                    columns.append(pa.array(c.view(np.int64)))
                for seed in (1, 2):
                    keys = partial_keys(sets, at, tables, width, seed)
                    ends = np.concatenate([[0], np.cumsum(some) * tables]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "c1", "c2", "a", "b"])
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, of_100: int) -> DataFrame:
    """The pairs (hub, node) whose sets have 100 * intersection >= of_100 * union. texts: (node, text).

    A hub's text goes to one stretch for each STRETCH of its nodes; each is read in order, the hub's text first.
    """
    stretches = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STRETCH).cast("int").alias("n"))
    member = pairs.join(stretches, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), "n").cast("int").alias("stretch"), F.lit(1).alias("member"))
    own = stretches.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("stretch"), F.lit(0).alias("member"))
    rows = member.union(own).join(texts, "node").repartition("hub", "stretch").sortWithinPartitions("hub", "stretch", "member", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for batch in batches:
            hub, stretch, node, member = (batch.column(k).to_numpy() for k in range(4))
            found = []
            for w in words(batch.column(4)):
                sets, ends = shingle_sets(w, shingle)
                for k, r in enumerate(range(w.lo, w.hi)):
                    own = sets[ends[k] : ends[k + 1]]
                    if at != (hub[r], stretch[r]):
                        at, hubs = (hub[r], stretch[r]), []
                    if not member[r]:
                        hubs.append(own.copy())  # more than one where rows share an id
                        continue
                    for other in hubs:
                        both = shared(own, other)
                        if 100 * both >= of_100 * (len(own) + len(other) - both):
                            found.append((hub[r], node[r]))
                            break
            yield _pairs(found)
        release()

    return rows.select("hub", "stretch", "node", "member", "text").mapInArrow(run, "a long, b long")


class Group:
    """Sets of one task: the rows of one block, or of two, whose pairs across are compared."""

    def __init__(self) -> None:
        self.sets: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.node: tuple[list[int], list[int]] = ([], [])
        self.component: tuple[list[int], list[int]] = ([], [])

    def add(self, side: int, node: int, component: int, own: np.ndarray) -> None:
        self.sets[side].append(own)
        self.node[side].append(node)
        self.component[side].append(component)

    def links(self, of_100: int) -> Iterator[tuple[int, int]]:
        """Links between different components, no more than join all that are linked."""
        left, right = self.sets
        inside = not right
        if not left or inside and len(left) < 2:
            return
        size = np.array([len(x) for x in left])
        keys, owner = np.concatenate(left), np.repeat(np.arange(len(left)), size)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        node = self.node[0] + self.node[1]
        label = np.array(self.component[0] + self.component[1])
        for j, own in enumerate(left if inside else right):
            me = j if inside else len(left) + j
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = hi - lo
            many = int(n.sum())
            if not many:
                continue
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(many)
            both = np.bincount(owner[at], minlength=len(left))
            near = 100 * both >= of_100 * (size + len(own) - both)
            for k in np.flatnonzero(near & (label[: len(left)] != label[me])).tolist():
                if label[k] != label[me]:
                    label[label == label[k]] = label[me]
                    yield node[k], node[me]


def confirm_clusters(members: DataFrame, texts: DataFrame, shingle: int, of_100: int) -> DataFrame:
    """Links (a, b) that join components. members: (node, cluster, component, size); texts: (node, text)."""
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum(F.col("size").cast("long") + 16) / A_BLOCK).cast("int").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    own = members.join(blocks.where("low != high"), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "n").cast("int"))
    tasks = own.select("cluster", "node", "component", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tasks = tasks.select("cluster", low.alias("low"), high.alias("high"), F.when(F.col("block") == low, 0).otherwise(1).alias("side"), "node", "component")
    by = ["cluster", "low", "high"]
    rows = tasks.join(texts, "node").repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, Group()
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for w in words(batch.column(6)):
                sets, ends = shingle_sets(w, shingle)
                for k, r in enumerate(range(w.lo, w.hi)):
                    task = (columns[0][r], columns[1][r], columns[2][r])
                    if task != at:
                        found += group.links(of_100)
                        at, group = task, Group()
                    group.add(columns[3][r], columns[4][r], columns[5][r], sets[ends[k] : ends[k + 1]].copy())
            yield _pairs(found)
        yield _pairs(list(group.links(of_100)))
        group = sets = None
        release()

    return rows.select(*by, "side", "node", "component", "text").mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 5, of_100: int = 80, tables: int = 14, width: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs (doc_id, text)."""
    sketches = written(sketch(docs, shingle, tables, width))
    own = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "c1", "c2"]
    sets = written(own.groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("a").alias("a"), F.first("b").alias("b")))

    def live(side: str, *more: str) -> DataFrame:
        rows = sets.select("node", *more, F.explode(side).alias(f"k{side}"))
        return rows.join(rows.groupBy(f"k{side}").agg(F.count("*").alias("n")).where("n > 1"), f"k{side}", "left_semi")

    keys = live("a", "n_shingles").join(live("b"), "node").select("node", F.col("n_shingles").cast("int").alias("size"), F.xxhash64("ka", "kb").alias("key"))
    keys = written(keys)
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last").drop("last")
    keys = written(keys.join(hubs, "key"))
    star = written(keys.where("node != hub").select("hub", "node").distinct())
    nodes = star.select("node").union(star.select("hub")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = written(texts.join(nodes.hint("merge"), "node", "left_semi"))  # as many as there are near copies: never broadcast

    links = written(confirm(star, texts, shingle, of_100))
    labels = components(links)

    known = keys.join(labels, "node", "left").select("key", "node", "size", "hub", F.coalesce("component", "node").alias("component"))
    apart = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    known = written(known.join(apart, "key", "left_semi"))
    nearest = known.groupBy("node").agg(F.min("hub").alias("near"))
    reach = known.select("key", "node").join(nearest, "node").groupBy("key").agg(F.min("near").alias("near"))
    clusters = known.select("key", "node", "size", "component").join(reach, "key")
    clusters = written(clusters.groupBy("node", "size", "component").agg(F.min("near").alias("cluster")))
    inside = written(confirm_clusters(clusters, texts, shingle, of_100))

    known = known.select("key", "node", "size", "component").join(clusters.select("node", "cluster"), "node")
    known = written(known)
    split = known.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low != high").select("key")
    known = known.join(split, "key", "left_semi")
    other = known.select("key", *(F.col(c).alias(f"other_{c}") for c in ("node", "size", "component", "cluster")))
    # the smaller set holds the intersection, the larger one is in the union
    fits = f"cluster < other_cluster AND component != other_component AND 100L * least(size, other_size) >= {of_100}L * greatest(size, other_size)"
    across = known.join(other, "key").where(fits).select(F.least("node", "other_node").alias("hub"), F.greatest("node", "other_node").alias("node")).distinct()
    across = written(across.join(star, ["hub", "node"], "left_anti"))
    more = written(inside.union(confirm(across, texts, shingle, of_100)))
    if more.limit(1).count():
        labels = components(links.union(more))

    belongs = sketches.select("doc_id", *same).join(sets.select(*same, "node"), same, "left").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return belongs.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: sets of four words over all whole texts of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.doc_id = e.a
), c AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
