"""Benchmark decontamination: windows of an item's size, SimHash, multi-index Hamming blocks, exact check.

Words are runs of letters and digits in lower case. A text's shingles are its five-word sequences, each
weighing as many as it has different words; an item of fewer words is one shingle. For each item, the
windows of its size in a document get a 64-bit SimHash of their weighted shingles. Fingerprints fall into
eight blocks of eight bits: two within RADIUS bits differ in at most RADIUS // 8 bits of some block, so
looking a window's blocks up in the items' tables of near values finds all within the radius. At the
similarity of 0.8 asked for, 9.7 of 64 bits differ on average and more than 23 in two windows of a million.
Candidates are confirmed by their weighted shingles: sum of least weights over sum of greatest.

Before windows are formed, two exact bounds apply: a window without any of an item's shingles has
similarity 0, and the item's shingles in the whole document must weigh 0.8 of the item. Windows are
fingerprinted and looked up some thousand at a time, so memory is that of the text itself.

Items come in blocks of bounded size (one block, unless there are BLOCK_BYTES of them) and every block is held
against all documents. Null and empty items and texts match nothing; equal items all match; of windows that tie
the first counts; rows of equal or null ids are rows of their own. Without items nothing matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.tables import table
from siltstone.llm.text import PUNCTUATION, U, Words, grams, release, words

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
#: Bounds of one block of items, which goes to every task.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 8 << 20
#: Windows and items that are looked up at once, and the stretch of words that windows fingerprinted at once span.
WINDOWS, ITEMS, SPAN = 4_096, 256, 16_384
_FILTER = 1 << 22
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def weights(h: np.ndarray, n: int) -> np.ndarray:
    """Different words in the n from each position on."""
    size = max(len(h) - n + 1, 0)
    out = np.ones(size, np.int32)
    for k in range(1, n):
        new = np.ones(size, bool)
        for j in range(k):
            new &= h[k : k + size] != h[j : j + size]
        out += new
    return out


def simhash(g: np.ndarray, weight: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the runs of `size` shingles that begin at `first`, as rows of eight bytes."""
    bits = np.unpackbits(g.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    total = np.zeros((len(g) + 1, 64), np.int32)
    np.cumsum(bits * weight[:, None], axis=0, out=total[1:])
    return np.packbits(total[first + size] - total[first] > 0, axis=1)


class Index:
    """A block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        column = pa.array([t for _, t in items], pa.string())
        ids, size, prints, keys, counts, of = [], [], [], [], [], []
        for w in words(column, PUNCTUATION):
            for r in range(len(w.first) - 1):
                h = w.hash[w.first[r] : w.first[r + 1]]
                if not len(h):
                    continue
                n = min(SHINGLE, len(h))
                g, weight = shingles(h, n)
                key, count = counted(g, weight)
                of.append(np.full(len(key), len(ids), np.int32))
                ids.append(items[w.lo + r][0])
                size.append(len(h))
                prints.append(simhash(g, weight, np.zeros(1, int), len(g))[0])
                keys.append(key)
                counts.append(count)
        self.ids, self.size, self.prints = ids, np.array(size, np.int64), np.array(prints, np.uint8).reshape(-1, 8)
        self.keys, self.counts = (np.concatenate(x) if x else np.zeros(0, U) for x in (keys, counts))
        self.at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        self.total = np.add.reduceat(self.counts, self.at[:-1]) if ids else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.key, self.item = self.keys[order], (np.concatenate(of) if of else np.zeros(0, np.int32))[order]
        self.filter = np.zeros(_FILTER, bool)
        self.filter[self.key & U(_FILTER - 1)] = True
        self.orders = sorted({min(SHINGLE, s) for s in size})
        near = [np.packbits(_POPCOUNT[np.arange(256) ^ self.prints[:, b, None]] <= RADIUS // 8, axis=1) for b in range(8)]
        self.near = np.stack(near)  # block, item, values as bits

    def candidates(self, prints: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, rows of prints within the radius, ascending) of the given items."""
        for k in range(0, len(items), ITEMS):
            own = items[k : k + ITEMS]
            found = np.zeros((len(own), len(prints)), bool)
            for b in range(8):
                found |= np.unpackbits(self.near[b][own], axis=1).view(bool)[:, prints[:, b]]
            for i, rows in zip(own.tolist(), found, strict=True):
                at = np.flatnonzero(rows)
                at = at[_POPCOUNT[prints[at] ^ self.prints[i]].sum(axis=1) <= RADIUS]
                if len(at):
                    yield i, at

    def hits(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Per row that has shingles of items: row, its words' hashes, positions and keys of those shingles, their length."""
        for n in self.orders:
            g = grams(w.hash, n)
            if n < SHINGLE:
                g = g ^ U(n)
            at = np.flatnonzero(self.filter[g & U(_FILTER - 1)])
            if len(at):
                k = np.searchsorted(self.key, g[at])
                at = at[self.key[np.minimum(k, len(self.key) - 1)] == g[at]]
            row = np.searchsorted(w.first, at, "right") - 1
            inside = at + n <= w.first[row + 1]
            at, row = at[inside], row[inside]
            for r, a, b in zip(*_runs(row), strict=True):
                first, last = w.first[r], w.first[r + 1]
                yield int(r), w.hash[first:last], at[a:b] - first, g[at[a:b]], n

    def search(self, g: np.ndarray, weight: np.ndarray, first: np.ndarray, size: int, items: np.ndarray, held: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> dict[int, tuple[float, int]]:
        """Of each item found: its best similarity to the windows of `size` shingles at `first`, and the first window that has it.

        held: positions of an item's shingles and the sums of their weights up to each; they bound similarities.
        """
        best: dict[int, tuple[float, int]] = {}
        total = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
        k = 0
        while k < len(first) and len(items):
            end = min(k + WINDOWS, int(np.searchsorted(first, first[k] + SPAN)))
            own, base = first[k:end], int(first[k])
            stop = int(own[-1]) + size
            prints = simhash(g[base:stop], weight[base:stop], own - base, size)
            for i, rows in self.candidates(prints, items):
                if held is not None:
                    at, sums = held[i]
                    begin = own[rows]
                    both = np.minimum(sums[np.searchsorted(at, begin + size)] - sums[np.searchsorted(at, begin)], self.total[i])
                    bound = both / (total[begin + size] - total[begin] + self.total[i] - both)
                    rows = rows[bound >= SIMILARITY - 1e-9]
                    rows = rows[np.argsort(-bound[bound >= SIMILARITY - 1e-9], kind="stable")]
                    bound = np.sort(bound[bound >= SIMILARITY - 1e-9])[::-1]
                for j, r in enumerate(rows.tolist()):
                    known, place = best.get(i, (0.0, -1))
                    if held is not None and bound[j] < known - 1e-9:
                        break
                    a = int(own[r])
                    s = self.similarity(i, *counted(g[a : a + size], weight[a : a + size]))
                    if s >= SIMILARITY and (s > known or s == known and a < place):
                        best[i] = (s, a)
            items = items[[best.get(i, (0.0, 0))[0] < 1 for i in items.tolist()]]  # a window can't be more alike
            k = end
        return best

    def similarity(self, i: int, key: np.ndarray, count: np.ndarray) -> float:
        """Weights are whole numbers, so this is exact."""
        own, have = self.keys[self.at[i] : self.at[i + 1]], self.counts[self.at[i] : self.at[i + 1]]
        k = np.minimum(np.searchsorted(own, key), len(own) - 1)
        both = int(np.minimum(have[k], count)[own[k] == key].sum())
        return both / (int(count.sum()) + int(self.total[i]) - both)

    def matches(self, w: Words) -> Iterator[tuple[int, int | None, float, int, int]]:
        """(row, item id, similarity, first word, words) of the best window of each item found."""
        for r, h, at, keys, n in self.hits(w):
            lo, hi = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
            many = hi - lo
            item = self.item[np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))]
            where = np.repeat(at.astype(np.int64), many)
            order = np.argsort(item, kind="stable")  # positions stay ascending within an item
            item, where = item[order], where[order]
            g, weight = shingles(h, n)
            edge = np.concatenate([np.flatnonzero(np.diff(item, prepend=-1)), [len(item)]])
            sums = np.concatenate([[0], np.cumsum(weight[where], dtype=np.int64)])
            have, own = sums[edge[1:]] - sums[edge[:-1]], item[edge[:-1]]
            fits = (have >= SIMILARITY * self.total[own] - 1e-9) & ((self.size[own] >= SHINGLE) if n == SHINGLE else (self.size[own] == n))
            for size in np.unique(self.size[own[fits]]).tolist():
                places = np.flatnonzero(fits & (self.size[own] == size))
                window = min(size, len(h))
                edges = np.zeros(len(h) - window + 2, np.int32)  # windows that hold one of their shingles
                held = {}
                for k in places.tolist():
                    spots = where[edge[k] : edge[k + 1]]
                    np.add.at(edges, np.clip(spots - (window - n), 0, len(h) - window), 1)
                    np.add.at(edges, np.minimum(spots, len(h) - window) + 1, -1)
                    held[int(own[k])] = (spots, sums[edge[k] : edge[k + 1] + 1])
                first = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
                found = self.search(g, weight, first, window - n + 1, own[places], held)
                for i, (s, a) in found.items():
                    yield r, self.ids[i], s, a, window


def _runs(row: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    if not len(row):
        return [], [], []
    edge = np.flatnonzero(np.diff(row)) + 1
    first = np.concatenate([[0], edge])
    return row[first].tolist(), first.tolist(), [*edge.tolist(), len(row)]


def shingles(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of the n-word shingles of a text."""
    g = grams(h, n)
    return (g ^ U(n) if n < SHINGLE else g), weights(h, n)


def counted(g: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sum of their weights."""
    order = np.argsort(g, kind="stable")
    key = g[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(weight[order].astype(np.int64), first)


def blocks(items: DataFrame) -> Iterator[Index]:
    """Items in order of id and text, as indexes of bounded size; one block is on the driver at a time."""
    block, held = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1])
        if len(block) == BLOCK_ITEMS or held > BLOCK_BYTES:
            yield Index(block)
            block, held = [], 0
    if block:
        yield Index(block)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of every document and item it holds; no shuffle of texts."""
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for index in blocks(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column(0), []
                for w in words(batch.column(1), PUNCTUATION):
                    found += [(ids[w.lo + r].as_py(), *rest) for r, *rest in shared.value.matches(w)]
                columns = list(zip(*found, strict=True)) if found else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = own.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that hold no item; no shuffle."""
    for index in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for w in words(batch.column(batch.schema.get_field_index(text)), PUNCTUATION):
                    for r, *_ in shared.value.matches(w):
                        keep[w.lo + r] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document of documents that holds an item of benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"
#: Exact similarities of all windows, without fingerprints.
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS w FROM documents
), i AS (
  SELECT item, item_id, w, len(w) AS size, least(5, len(w)) AS n FROM (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), counted AS (
  SELECT item, n, g, sum(weight) AS c FROM (
    SELECT item, n, array_to_string(x, ' ') AS g, len(list_distinct(x)) AS weight FROM (SELECT item, n, unnest(list_transform(range(1, size - n + 2), lambda p: w[p:p + n - 1])) AS x FROM i)
  ) GROUP BY ALL
), totals AS (
  SELECT item, sum(c) AS total FROM counted GROUP BY item
), s AS (
  SELECT doc, n, p, array_to_string(w[p:p + n - 1], ' ') AS g, len(list_distinct(w[p:p + n - 1])) AS weight
  FROM (SELECT doc, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
), pairs AS (
  SELECT doc, item, any_value(total) AS total FROM s JOIN counted USING (n, g) JOIN totals USING (item) GROUP BY doc, item HAVING sum(weight) >= 0.8 * any_value(total) - 1e-9
), windows AS (
  SELECT doc, item, total, n, least(size, len(d.w)) AS n_words, unnest(range(1, len(d.w) - least(size, len(d.w)) + 2)) AS a FROM pairs JOIN d USING (doc) JOIN i USING (item)
), held AS (
  SELECT x.doc, x.item, x.a, x.n_words, x.total, s.g, x.n, sum(s.weight) AS have FROM windows x JOIN s ON s.doc = x.doc AND s.n = x.n AND s.p BETWEEN x.a AND x.a + x.n_words - x.n GROUP BY ALL
), likeness AS (
  SELECT h.doc, h.item, h.a, h.n_words, sum(least(have, coalesce(c, 0)))::DOUBLE AS common, sum(have)::DOUBLE AS own, any_value(h.total)::DOUBLE AS total
  FROM held h LEFT JOIN counted USING (item, n, g) GROUP BY ALL
), best AS (
  SELECT doc, item, n_words, a, common / (own + total - common) AS similarity, row_number() OVER (PARTITION BY doc, item ORDER BY common / (own + total - common) DESC, a) AS nr FROM likeness WHERE common / (own + total - common) >= 0.8
)
SELECT doc_id, item_id, similarity, a - 1 AS first_word, n_words FROM best JOIN d USING (doc) JOIN i USING (item) WHERE nr = 1
"""
