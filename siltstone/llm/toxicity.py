"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is logistic in its words; a document is toxic if any of its sentences is (noisy-or):
1 - prod(1 - p). Weights are fitted to document labels alone, and then tell which sentences offend. A sentence
counts by how far its -log(1 - p) is above that of a sentence without features, which a text has once however
long it is: sentences that tell nothing, or only good, add nothing.

Features are words and the first `PREFIXES` bytes of longer ones, so rare and unseen forms of a marked stem
count too; a sentence has each once. All of them are in the objective, under an L1 penalty of the same strength
at every size: weights stay zero whose gradient is no more than `L1`. Those that don't are fitted once more under
a slight L2 penalty. The classifier is fitted on a bounded sample of the labelled rows: at most `SAMPLE` of those
with the least hash of their id, and no more than `SAMPLE_BYTES` of text. Everything else covers all documents.

Null and empty texts, and texts without words, are one sentence without words; very long texts are sentences like
others. Null labels and ids teach nothing, other labels than 0 and 1 neither; with no labels, or of one kind
only, all scores are equal. Equal texts score alike; rows that repeat an id are rows of their own, in the sample
too. A column toxic_score or offending is replaced. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.tables import crc, table
from siltstone.llm.text import FIRST, PUNCTUATION, U, Words, mix, release, words

SAMPLE, SAMPLE_BYTES = 20_000, 8 << 20
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6, 7, 8)
L1, L2 = 1.5, 0.1
CUTOFF = 0.7
_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?\n"]] = True


class Model(NamedTuple):
    bias: float
    weights: np.ndarray  # by bucket


class Sentences(NamedTuple):
    """Of one chunk: each sentence's first word, each row's first sentence (both with an end)."""

    w: Words
    first: np.ndarray
    of_row: np.ndarray


def sentences(column: pa.Array) -> Iterator[Sentences]:
    for w in words(column, PUNCTUATION):
        n = len(w.start)
        ends = np.concatenate([[0], np.cumsum(_ENDS[w.data])])[w.start]
        new = np.ones(n, bool)
        new[1:] = ends[1:] != ends[:-1]
        new[w.first[:-1][w.first[:-1] < n]] = True
        first = np.append(np.flatnonzero(new), n)
        yield Sentences(w, first, np.searchsorted(first, w.first))


def features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words, ascending, and their buckets: of all whole words, then of the prefixes of each length."""
    yield np.arange(len(w.start)), (w.hash & U(BUCKETS - 1)).astype(np.int32)
    for n in PREFIXES:
        longer = np.flatnonzero(w.end - w.start > n)
        yield longer, (mix((w.eight[w.start[longer]] & FIRST[n]) * U(2 * n + 1) + U(n)) & U(BUCKETS - 1)).astype(np.int32)


def by_sentence(s: Sentences, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, bucket) of each feature a sentence has, ascending; with keep, only of buckets it marks."""
    found = []
    for word, bucket in features(s.w):
        if keep is not None:
            some = keep[bucket]
            word, bucket = word[some], bucket[some]
        found.append((np.searchsorted(s.first, word, "right") - 1) << 32 | bucket)
    key = np.unique(np.concatenate(found))
    return key >> 32, key & 0xFFFFFFFF


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def above(score: np.ndarray, bias: float) -> np.ndarray:
    """What sentences add to their text's -log(1 - P) beyond a sentence without features."""
    return np.maximum(softplus(score) - softplus(bias), 0)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each run of values; first has an end."""
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[first])


class Bags:
    """Labelled documents as features of sentences; feature f is bucket buckets[f]. Every sentence has features."""

    def __init__(self, y: np.ndarray, buckets: np.ndarray, feature: np.ndarray, sentence: np.ndarray, doc: np.ndarray) -> None:
        """feature and sentence: one for each feature of a sentence, in order of sentences; doc: by sentence."""
        self.y, self.buckets, self.feature, self.sentence, self.doc = y, buckets, feature, sentence, doc
        order = np.argsort(feature, kind="stable")
        self.sentence_of = sentence[order]  # in order of features
        self.of_sentence, self.of_feature = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (sentence, feature[order]))

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        """Of sentences; w by feature."""
        return bias + np.add.reduceat(w[self.feature], self.of_sentence) if len(self.feature) else np.zeros(0)

    def likelihood(self, w: np.ndarray, bias: float) -> float:
        """Log-likelihood of the labels."""
        quiet = softplus(bias) + np.bincount(self.doc, above(self.scores(w, bias), bias), len(self.y))  # -log(1 - P)
        return float(np.where(self.y == 1, np.log(np.maximum(-np.expm1(-quiet), 1e-300)), -quiet).sum())

    def gradient(self, w: np.ndarray, bias: float) -> np.ndarray:
        """Derivatives of the likelihood by the weight of every feature, and at the end by the bias."""
        s = self.scores(w, bias)
        more = s >= bias
        quiet = softplus(bias) + np.bincount(self.doc, above(s, bias), len(self.y))
        odds = np.where(self.y == 1, np.exp(-quiet) / np.maximum(-np.expm1(-quiet), 1e-12), -1.0)
        own = odds[self.doc]
        slope = own * more / (1 + np.exp(-s))
        null = (odds.sum() - own[more].sum()) / (1 + np.exp(-bias))
        by_feature = np.add.reduceat(slope[self.sentence_of], self.of_feature) if len(self.feature) else np.zeros(0)
        return np.append(by_feature, slope.sum() + null)

    def only(self, kept: np.ndarray) -> Bags:
        """With the features of a mask, and the sentences that have some."""
        some = kept[self.feature]
        sentence, at = np.unique(self.sentence[some], return_inverse=True)
        return Bags(self.y, self.buckets[kept], (np.cumsum(kept) - 1)[self.feature[some]], at, self.doc[sentence])


def bags(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Bags:
    """rows: label, buckets of all sentences one after the other, how many each sentence has."""
    size = np.concatenate([r[2] for r in rows])
    buckets, feature = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    some = size > 0
    return Bags(np.array([r[0] for r in rows], float), buckets, feature.astype(np.int32), np.repeat(np.arange(some.sum(), dtype=np.int32), size[some]), doc[some])


def ascend(b: Bags, w: np.ndarray, bias: float, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of greatest penalised likelihood, by Adam with shrinkage, from w and bias on."""
    theta = np.append(w, bias)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = b.gradient(theta[:-1], theta[-1])
        g[:-1] -= l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 * (1 - 0.9 * step / steps) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta += rate * m / (1 - 0.9**step)
        if l1:
            theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - rate[:-1] * l1, 0)
    return theta[:-1], float(theta[-1])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], l1: float = L1, l2: float = L2, steps: int = 200) -> Model:
    """rows: label, buckets of all sentences one after the other, how many each sentence has."""
    weights = np.zeros(BUCKETS, np.float32)
    n, toxic = len(rows), sum(r[0] for r in rows)
    bias = float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    if toxic in (0, n):
        return Model(bias, weights)
    b = bags(rows)
    w, bias = ascend(b, np.zeros(len(b.buckets)), bias - 1, l1, 0.0, steps)
    part = b.only(w != 0)
    weights[part.buckets], bias = ascend(part, w[w != 0], bias, 0.0, l2, 2 * steps)
    return Model(bias, weights)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """labels: (doc_id, toxic), only rows to learn from."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)  # at most `sample` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(own), "doc_id")
    size = texts.groupBy(F.xxhash64("doc_id").alias("place"), "doc_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")).toPandas()
    size = size.sort_values(["place", "doc_id"])
    chosen = size["doc_id"][size["bytes"].cumsum() <= sample_bytes]
    chosen = docs.sparkSession.createDataFrame([(int(x),) for x in chosen], "doc_id long")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in sentences(batch.column(1)):
                sentence, bucket = by_sentence(s)
                size = np.bincount(sentence, minlength=len(s.first) - 1).astype(np.int32)
                at, rows = np.searchsorted(sentence, s.of_row).tolist(), range(len(s.of_row) - 1)
                bucket, first = bucket.astype(np.int32), s.of_row.tolist()
                columns = (pa.array([x[e[r] : e[r + 1]].tobytes() for r in rows], pa.binary()) for x, e in ((bucket, at), (size, first)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.w.lo, len(rows)), *columns], ["toxic", "bucket", "size"])
        release()

    got = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(pick, "toxic int, bucket binary, size binary").toArrow().to_pydict()
    return fit([(t, np.frombuffer(b, np.int32), np.frombuffer(s, np.int32)) for t, b, s in sorted(zip(*got.values(), strict=True))])


def probabilities(model: Model, s: Sentences, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, and of each sentence. keep: the buckets that have a weight."""
    sentence, bucket = by_sentence(s, keep)
    score = model.bias + np.bincount(sentence, model.weights[bucket], len(s.first) - 1)
    quiet = softplus(np.array(model.bias)) + sums(above(score, model.bias), s.of_row)
    return -np.expm1(-quiet), 1 / (1 + np.exp(-score))


def scored(model: Model, column: pa.Array) -> Iterator[tuple[Sentences, np.ndarray, np.ndarray]]:
    """Sentences of each run of rows, with the probabilities of rows and sentences."""
    keep = model.weights != 0
    for s in sentences(column):
        yield s, *probabilities(model, s, keep)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxic_score, in place of a column of that name; no shuffle."""
    docs = docs.drop("toxic_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number for each of BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for _, p, _ in scored(shared.value, batch.column(batch.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else [], pa.float64())], [*batch.schema.names, "toxic_score"])

    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs, all their columns, whose score is below the cutoff; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for _, p, _ in scored(shared.value, batch.column(batch.schema.get_field_index(text)))]
            yield batch.filter(pa.array(np.concatenate(found) < cutoff)) if found else batch
        release()

    return docs.mapInArrow(run, docs.schema)


def locate(docs: DataFrame, model: Model, text: str = "text", cutoff: float = 0.5) -> DataFrame:
    """docs with offending: (start, end, score) of sentences scored cutoff or more, from first word to last, in code points. A column of that name is replaced."""
    docs = docs.drop("offending")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("offending", kind)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for s, _, p in scored(shared.value, batch.column(batch.schema.get_field_index(text))):
                for k in np.flatnonzero(p >= cutoff).tolist():
                    r = int(np.searchsorted(s.of_row, k, "right")) - 1
                    base, a, b = s.w.offsets[r], s.w.start[s.first[k]], s.w.end[s.first[k + 1] - 1]
                    chars = lambda x, y, d=s.w.data: int(((d[x:y] & 0xC0) != 0x80).sum())
                    start = chars(base, a)
                    out[s.w.lo + r].append({"start": start, "end": start + chars(a, b), "score": float(p[k])})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, "offending"])

    return docs.mapInArrow(run, schema)


def learn(spark: SparkSession, sf_dir: str) -> Model:
    """From the labels of rows whose crc32 is not 1 modulo 3."""
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(crc("doc_id", 3) != 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the toxicity of every whole text of documents."""
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), learn(spark, sf_dir))
    return scored.select("doc_id", (crc("doc_id", 3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= CUTOFF).cast("int").alias("predicted"))
