"""Language identification as inference of a multilingual mixture.

Each language has likelihoods of byte trigrams, counted over all training texts into BUCKETS hashed
buckets. A word's likelihood in a language is that of its trigrams, its edges included. Expectation-
maximisation estimates how much of a document's words each language has, and languages join the set one
by one, the most frequent first, as long as the likelihood gains more than PENALTY * log(words + 1) for
each. The prediction is the largest proportion in the set.

Null and empty texts and texts without a letter are `und`, score 0, and so is every text if nothing was learned;
an empty table has no rows. Texts whose language is null teach nothing. Equal proportions go to the first
language in order of name. A text of more than A_PIECE likelihoods is read in pieces, once for each round, so
memory doesn't grow with it; an unbroken run of letters longer than a piece counts as several words. Repeated
rows are rows of their own. Columns that are kept may have any name but those that are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.tables import crc, table
from siltstone.llm.text import chunks

BUCKETS = 1 << 16
SMOOTHING, PENALTY, ROUNDS = 0.1, 2.0, 8
#: Numbers (bytes times languages) that one piece of texts takes at most.
A_PIECE = 1 << 21
UNDETERMINED = "und"
_FOLD = np.full(256, 32, np.int32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


_SET = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # bucket, language


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram from each padded position on; words' first and behind last trigram; each row's first word."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    where = np.arange(len(data)) + np.repeat(np.arange(n) * 2 + 1, size)  # a blank on both sides of each row
    b = np.full(len(data) + 2 * n + 2, 32, np.int32)
    b[where] = _FOLD[data]
    h = (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    solid = b != 32
    start = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    end = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    return h, start - 1, end - 1, np.searchsorted(start, offsets + np.arange(n + 1) * 2)


def train(docs: DataFrame) -> Model:
    """docs: (text, lang), only rows to learn from. The counts of a language are at most BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(1)
            for name in lang.unique().to_pylist():
                own = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                for _, _, data, offsets in chunks(batch.column(0).filter(pa.compute.equal(lang, name)), A_PIECE):
                    for a, b in cuts(data, A_PIECE) if len(data) > A_PIECE else [(0, len(data))]:
                        h, first, end, _ = trigrams(data[a:b], np.array([0, b - a]) if len(data) > A_PIECE else offsets)
                        inside = np.zeros(len(h) + 1, np.int8)
                        np.add.at(inside, first, 1)
                        np.add.at(inside, end, -1)
                        own += np.bincount(h[np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
        for name, own in counts.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(own[some])], ["lang", "bucket", "n"])

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    total = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(total["lang"].unique().to_pylist())
    counts = np.full((BUCKETS, len(names)), SMOOTHING)
    if names:
        column = pa.compute.index_in(total["lang"].combine_chunks(), pa.array(names)).to_numpy()
        counts[total["bucket"].to_numpy(), column] += total["n"].to_numpy()
    return Model(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def word_likelihoods(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word in each language; each row's first word."""
    h, first, end, of_row = trigrams(data, offsets)
    total = np.zeros((len(h) + 1, len(model.languages)))
    np.cumsum(model.log_p[h], axis=0, out=total[1:])
    return total[end] - total[first], of_row


def mixture(p: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each row's words, and their log-likelihood (of p). Every row has words."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        q = p * np.repeat(share, size, axis=0)
        q /= np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(q, first, axis=0) / size[:, None]
    q = (p * np.repeat(share, size, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(q, 1e-300)), first)


def headroom(p: np.ndarray, first: np.ndarray, size: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How far each row's log-likelihood can still rise above that of share, whatever the proportions.

    It is concave in them: at most size * log(max over languages of the mean of p / q).
    """
    q = (p * np.repeat(share, size, axis=0)).sum(axis=1, keepdims=True)
    mean = np.add.reduceat(p / np.maximum(q, 1e-300), first, axis=0) / size[:, None]
    return size * np.log(np.maximum(mean.max(axis=1), 1.0))


def infer(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each row (0 outside its set; all 0 without words), and how sure the best language is."""
    word, of_row = word_likelihoods(model, data, offsets)
    n, many = len(of_row) - 1, len(model.languages)
    shares, sure = np.zeros((n, many)), np.zeros(n)
    size = np.diff(of_row)
    rows = np.flatnonzero(size)
    if not len(rows):
        return shares, sure
    first, size = of_row[:-1][rows], size[rows]
    top = word.max(axis=1, keepdims=True)
    p = np.exp(word - top)
    single = np.add.reduceat(word - top, first, axis=0)
    share, bound = mixture(p, first, size, np.ones((len(rows), many)))
    order = np.argsort(-share, axis=1, kind="stable")
    best = single.argmax(axis=1)
    chosen = np.zeros((len(rows), many))
    chosen[np.arange(len(rows)), best] = 1
    gained, price = single.max(axis=1), PENALTY * np.log(size + 1)
    open_rows = np.flatnonzero(bound + headroom(p, first, size, share) - gained > price)  # for the others no set gains enough
    for k in range(2, many + 1):
        if not len(open_rows):
            break
        allowed = np.zeros((len(open_rows), many))
        np.put_along_axis(allowed, order[open_rows, :k], 1, axis=1)
        at = np.concatenate([np.arange(first[r], first[r] + size[r]) for r in open_rows])
        own = size[open_rows]
        got, fit = mixture(p[at], np.concatenate([[0], np.cumsum(own)[:-1]]), own, allowed)
        better = fit - gained[open_rows] > price[open_rows]
        taken = open_rows[better]
        chosen[taken], gained[taken] = got[better], fit[better]
        open_rows = taken
    shares[rows] = chosen
    sure[rows] = 1 / np.exp(single - single.max(axis=1, keepdims=True)).sum(axis=1)
    return shares, sure


def cuts(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most `most` bytes, cut behind a byte that is no letter where there is one."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + most, n)
        if end < n:
            blank = np.flatnonzero(_FOLD[data[at:end]] == 32)
            end = at + int(blank[-1]) + 1 if len(blank) else end
        yield at, end
        at = end


def infer_long(model: Model, data: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """As `infer` for one text, which is read in pieces of `most` bytes, once for each round."""
    many = len(model.languages)

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in cuts(data, most):
            word, _ = word_likelihoods(model, data[a:b], np.array([0, b - a]))
            if len(word):
                own = word - word.max(axis=1, keepdims=True)
                yield own, np.exp(own)

    single, n = np.zeros(many), 0
    for own, p in pieces():
        single += own.sum(axis=0)
        n += len(p)
    if not n:
        return np.zeros(many), 0.0

    def mix(allowed: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Proportions, log-likelihood, and how far it can still rise."""
        share = allowed / allowed.sum()
        for last in [False] * ROUNDS + [True]:
            total, fit = np.zeros(many), 0.0
            for _, p in pieces():
                q = np.maximum(p @ share, 1e-300)
                total += (p / q[:, None]).sum(axis=0)
                fit += np.log(q).sum()
            if not last:
                share = share * total / n
        return share, fit, n * np.log(max(total.max() / n, 1.0))

    share, bound, more = mix(np.ones(many))
    order, price = np.argsort(-share, kind="stable"), PENALTY * np.log(n + 1)
    best, gained = np.zeros(many), single.max()
    best[single.argmax()] = 1
    if bound + more - gained > price:
        for k in range(2, many + 1):
            allowed = np.zeros(many)
            allowed[order[:k]] = 1
            got, fit, _ = mix(allowed)
            if fit - gained <= price:
                break
            best, gained = got, fit
    return best, float(1 / np.exp(single - single.max()).sum())


def identify(docs: DataFrame, model: Model, *keep: Column | str, text: str = "text") -> DataFrame:
    """The columns keep, lang_pred, score, and languages: (lang, share) of the set, the largest share first. No shuffle."""
    kept = docs.select(*keep)
    inner = F.struct(F.col(text).cast("string").alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    own = docs.select(*keep, inner.alias("said"))  # the last column, read by its place
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    added = ["lang_pred", "score", "languages"]
    schema = T.StructType(kept.schema.fields).add("lang_pred", "string").add("score", "double").add("languages", _SET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            said, letters = (batch.column(batch.num_columns - 1).field(k) for k in range(2))
            letters = letters.to_pylist()
            names, scores, sets = [UNDETERMINED] * n, [0.0] * n, [[] for _ in range(n)]
            most = max(A_PIECE // max(len(m.languages), 1), 1)
            for lo, hi, data, offsets in chunks(said, most) if m.languages else ():
                if len(data) > most:
                    shares, sure = (np.array([x]) for x in infer_long(m, data, most))
                else:
                    shares, sure = infer(m, data, offsets)
                best, value = shares.argmax(axis=1), shares.max(axis=1)
                for r in range(hi - lo):
                    if letters[lo + r] and value[r] > 0:
                        names[lo + r] = m.languages[best[r]]
                        scores[lo + r] = float(value[r] * sure[r]) if value[r] == 1 else float(value[r])
                        some = np.flatnonzero(shares[r] > 0)
                        sets[lo + r] = [{"lang": m.languages[k], "share": float(shares[r, k])} for k in some[np.argsort(-shares[r, some], kind="stable")]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names), pa.array(scores), pa.array(sets, kind)], [*batch.schema.names[:-1], *added])

    return own.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the language of every whole text of documents, learned from rows whose crc32 is not 2 modulo 4."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc("doc_id", 4) != 2))
    return identify(docs, model, "doc_id", (crc("doc_id", 4) == 2).alias("held_out"))
