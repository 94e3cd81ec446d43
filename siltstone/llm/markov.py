"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by scaled forward recursion.

Tokens are words in lower case and one end for each text. The states emit classes: each of the STATED most
frequent tokens is a class of its own, and all other words fall into ENDINGS classes by their last three
bytes; within a class a word has its smoothed share of the class's counts, and unseen words share one more
place. So the states' tables have a fixed size, and the probabilities of all words, seen or not, add up to 1.

Counts of all words are a table (word, n) that grows with the input. The HEAD most frequent ones, a fixed
number, go to every task; other words of a text are joined with the table. Texts become class numbers once;
each round of Baum-Welch reads these and adds up expected counts over partitions.

Null and empty texts are one end; long texts walk in stretches and lose nothing by it. Repeated rows and ids are
texts of their own; a null id counts as an empty one for the split. Words of equal counts are in order of their
bytes. With no training texts every token has base probability 1 / 1; an empty table has no scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.tables import crc, crc_sql, table, written

HEAD, STATED, ENDINGS = 400_000, 16_000, 1_024
STATES, ROUNDS = 8, 4
#: Words that a task counts before it passes them on, and tokens that walk side by side.
COUNTED, ABREAST = 500_000, 600_000
#: Tokens of a stretch: longer texts are cut, and walk side by side with themselves.
A_STRETCH = 2_048
_STAY, _PRIOR = 0.9, 1_000.0


def ending(word: bytes) -> int:
    return (int.from_bytes(word[-3:], "little") * 2654435761 >> 11) % ENDINGS


def texts(batch: pa.RecordBatch, k: int) -> Iterator[list[bytes]]:
    """Words of each row: `lower` and `split` of bytes know exactly A-Z and the six blanks."""
    for t in batch.column(k).cast(pa.binary()).to_pylist():
        yield (t or b"").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of a column of texts, without ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for words in texts(batch, 0):
                counts.update(words)
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    """The frequent words and what is known of all."""

    number: dict[bytes, int]
    count: np.ndarray  # by number
    kind: np.ndarray  # class by number; 0 is the end
    kinds: int
    ends: int
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    def log_base(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    def log_class(self) -> np.ndarray:
        return np.log10(self.class_total + 0.5 * (self.class_distinct + 1))


def vocabulary(counts: DataFrame, ends: int, stated: int | None = None) -> Vocabulary:
    """counts: a written table. Only words from a count on that at most HEAD words have come to the driver.

    stated: how many words are classes of their own (STATED if not given); classes are numbers of 16 bits.
    """
    rank = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(((r["rank"], r["words"], r["tokens"]) for r in counts.groupBy(rank.alias("rank")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()), reverse=True)
    least, taken = None, 0
    for step, words, _ in steps:
        if taken + words > HEAD:
            break
        least, taken = step, taken + words
    head = counts.where(rank >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    pairs = sorted(zip(head["word"].to_pylist(), head["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    number = {w: k for k, (w, _) in enumerate(pairs)}
    stated = min(STATED if stated is None else stated, len(pairs), (1 << 16) - ENDINGS - 1)
    kind = np.concatenate([np.arange(1, stated + 1), np.array([stated + 1 + ending(w) for w, _ in pairs[stated:]], int)]).astype(np.int32)
    count = np.array([n for _, n in pairs], np.int64)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([ending(w) for w in batch.column(0).to_pylist()], pa.int32()), batch.column(1)], ["ending", "n"])

    tail = counts.where(rank < least) if least is not None else counts
    rest = tail.mapInArrow(classes, "ending int, n long").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    class_total, class_distinct = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    class_total[rest["ending"].to_numpy()], class_distinct[rest["ending"].to_numpy()] = rest["n"].to_numpy(), rest["words"].to_numpy()
    own = kind[stated:] - stated - 1
    class_total += np.bincount(own, count[stated:], ENDINGS).astype(np.int64)
    class_distinct += np.bincount(own, minlength=ENDINGS)
    words, tokens = sum(s[1] for s in steps), sum(s[2] for s in steps)
    return Vocabulary(number, count, kind, 1 + stated + ENDINGS, ends, tokens + ends, words + (ends > 0), class_total, class_distinct)


def numbered(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Of (doc_id, text, held_out): with n_tokens, class numbers as bytes, sums over frequent words, and the other words."""
    shared = docs.sparkSession.sparkContext.broadcast(v)  # HEAD words at most
    schema = "doc_id long, held_out boolean, n_tokens long, kinds binary, n_known long, log_counts double, log_inside double, rare array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        get = v.number.get
        log_count, log_class = np.log10(v.count + 0.5), v.log_class()
        stated = v.kinds - ENDINGS - 1
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                rows = []
                for words in texts(batch, 1):
                    at = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    seen = at >= 0
                    kinds = np.zeros(len(words) + 1, np.uint16)
                    kinds[:-1][seen] = v.kind[at[seen]]
                    rare = [words[k] for k in np.flatnonzero(~seen).tolist()]
                    kinds[:-1][~seen] = np.array([ending(w) for w in rare], int) + stated + 1
                    known = log_count[at[seen]]
                    inner = kinds[:-1] > stated
                    inside = known[v.kind[at[seen]] > stated].sum() - log_class[kinds[:-1][inner].astype(int) - stated - 1].sum()
                    rows.append((len(words) + 1, kinds.tobytes(), int(seen.sum()) + (v.ends > 0), known.sum() + np.log10(v.ends + 0.5), inside, rare))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["doc_id", "held_out", "n_tokens", "kinds", "n_known", "log_counts", "log_inside", "rare"]
                )

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


class Hmm(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class, state


class Walk:
    """Stretches side by side, the longest first; everything is by time and then stretch.

    before: state probabilities at each stretch's first token, from what comes before it.
    """

    def __init__(self, stretches: list[np.ndarray], before: np.ndarray) -> None:
        size = np.array([len(s) for s in stretches])
        self.order = np.argsort(-size, kind="stable")
        self.before = before[self.order]
        size = size[self.order]
        self.live = (len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), "right")).tolist()
        self.at = np.concatenate([[0], np.cumsum(self.live)]).tolist()
        first = np.concatenate([[0], np.cumsum([len(s) for s in stretches])])[:-1][self.order]
        flat = np.concatenate(stretches)
        self.kinds = np.empty(len(flat), np.int32)
        for t, n in enumerate(self.live):
            self.kinds[self.at[t] : self.at[t] + n] = flat[first[:n] + t]

    def given_order(self, x: np.ndarray) -> np.ndarray:
        back = np.empty_like(x)
        back[self.order] = x
        return back

    def products(self, m: Hmm) -> np.ndarray:
        """Of each stretch, the matrix that takes state probabilities before its first token to those at its last, up to a factor."""
        emit, out = m.emit[self.kinds], np.empty((len(self.order), *m.move.shape))
        k = None
        for t, n in enumerate(self.live):
            e = emit[self.at[t] : self.at[t] + n]
            k = e[:, None, :] * (np.eye(len(m.move)) if k is None else k[:n] @ m.move)
            k /= k.sum(axis=(1, 2), keepdims=True)
            out[:n] = k
        return self.given_order(out)

    def forward(self, m: Hmm, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """log10 likelihoods, state probabilities given the past, scales, emissions."""
        emit = m.emit[self.kinds]
        scale = np.empty(len(emit))
        past = np.empty_like(emit) if keep else None
        a = None
        for t, n in enumerate(self.live):
            lo = self.at[t]
            a = (self.before if a is None else a[:n] @ m.move) * emit[lo : lo + n]
            c = scale[lo : lo + n] = a.sum(axis=1)
            a /= c[:, None]
            if keep:
                past[lo : lo + n] = a
        logs, out = np.log10(scale), np.zeros(len(self.order))
        for t, n in enumerate(self.live):
            out[:n] += logs[self.at[t] : self.at[t] + n]
        return self.given_order(out), past, scale, emit

    def expected(self, m: Hmm, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Moves, emissions, log10 likelihoods, states at the first token, and what the first token and all behind it say of the state there.

        behind: up to a factor, what follows each stretch says of the state at its last token.
        """
        logs, state, scale, emit = self.forward(m, True)
        behind = behind[self.order]
        emit /= scale[:, None]
        moves = np.zeros_like(m.move)
        ahead, later = None, 0
        for t in range(len(self.live) - 1, -1, -1):
            lo, n = self.at[t], self.live[t]
            future = np.empty((n, len(m.start)))
            last = state[lo + later : lo + n]  # stretches that end here
            future[later:] = behind[later:n] / np.maximum((last * behind[later:n]).sum(axis=1, keepdims=True), 1e-300)
            if ahead is not None:
                moves += state[lo : lo + later].T @ ahead
                future[:later] = ahead @ m.move.T
            ahead, later = emit[lo : lo + n] * future, n
            state[lo : lo + n] *= future
        emissions = np.stack([np.bincount(self.kinds, state[:, k], len(m.emit)) for k in range(len(m.start))], axis=1)
        return moves * m.move, emissions, logs, self.given_order(state[: self.live[0]]), self.given_order(ahead)


class Stretches:
    """Sequences cut into stretches of at most A_STRETCH tokens, so that a long one walks side by side with itself.

    The matrix of each stretch of a long sequence says how it takes states before it to states at its end; from
    these follow what comes before and behind each stretch, and then all stretches are alike. Nothing is lost.
    """

    def __init__(self, m: Hmm, rows: list[np.ndarray]) -> None:
        self.m, self.n, states = m, len(rows), len(m.start)
        self.parts = [x[k : k + A_STRETCH] for x in rows for k in range(0, len(x), A_STRETCH)]
        many = np.array([-(-len(x) // A_STRETCH) for x in rows])
        self.row = np.repeat(np.arange(len(rows)), many)
        self.first = np.concatenate([[0], np.cumsum(many)])[:-1]
        self.before, self.behind = np.tile(m.start, (len(self.parts), 1)), np.ones((len(self.parts), states))
        self.end_before = np.zeros((len(self.parts), states))  # states at the end of the stretch before
        long = np.flatnonzero(many > 1)
        inner = [k for r in long.tolist() for k in range(self.first[r], self.first[r] + many[r])]
        product = {}
        for group in together([self.parts[k] for k in inner]):
            own = [inner[g] for g in group]
            product |= dict(zip(own, Walk([self.parts[k] for k in own], self.before[own]).products(m), strict=True))
        for r in long.tolist():
            lo, hi = int(self.first[r]), int(self.first[r] + many[r])
            for k in range(lo, hi - 1):
                end = self.before[k] @ product[k]
                self.end_before[k + 1] = end / end.sum()
                self.before[k + 1] = self.end_before[k + 1] @ m.move
            for k in range(hi - 1, lo, -1):
                back = m.move @ (product[k] @ self.behind[k])
                self.behind[k - 1] = back / back.sum()

    def groups(self) -> Iterator[tuple[list[int], Walk]]:
        for group in together(self.parts):
            yield group, Walk([self.parts[k] for k in group], self.before[group])

    def likelihoods(self) -> np.ndarray:
        """log10 of each sequence."""
        out = np.zeros(self.n)
        for group, walk in self.groups():
            np.add.at(out, self.row[group], walk.forward(self.m, False)[0])
        return out

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions, and the log10 likelihood of all."""
        start, moves, emissions, log = np.zeros_like(self.m.start), np.zeros_like(self.m.move), np.zeros_like(self.m.emit), 0.0
        begins = np.zeros(len(self.parts), bool)
        begins[self.first] = True
        for group, walk in self.groups():
            move, emit, logs, state, ahead = walk.expected(self.m, self.behind[group])
            opening = begins[group]
            start += state[opening].sum(axis=0)
            moves += move + (self.end_before[group][~opening].T @ ahead[~opening]) * self.m.move
            emissions += emit
            log += float(logs.sum())
        return start, moves, emissions, log


def together(rows: list[np.ndarray]) -> Iterator[list[int]]:
    """Groups of sequences of like lengths, ABREAST tokens in each or one sequence."""
    group, held = [], 0
    for k in sorted(range(len(rows)), key=lambda k: -len(rows[k])):
        if group and held + len(rows[k]) > ABREAST:
            yield group
            group, held = [], 0
        group.append(k)
        held += len(rows[k])
    if group:
        yield group


def sequences(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in batch.column(k).to_pylist()]


def first_guess(v: Vocabulary, states: int = STATES, seed: int = 7) -> Hmm:
    share = np.zeros(v.kinds)
    share[0] = v.ends
    np.add.at(share, v.kind, v.count)
    stated = v.kinds - ENDINGS - 1
    share[stated + 1 :] = v.class_total
    share = (share + 0.5) / (share + 0.5).sum()
    emit = share[:, None] * np.exp(np.random.default_rng(seed).normal(0, 0.3, (v.kinds, states)))
    move = np.full((states, states), (1 - _STAY) / max(states - 1, 1))
    np.fill_diagonal(move, _STAY if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def baum_welch(rows: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """rows: (kinds) of all training texts, a written table. The model, and the log10 likelihood before each round."""
    m, logs = first_guess(v, states), []
    share = m.emit.mean(axis=1)
    schema = "row int, " + ", ".join(f"s{k} double" for k in range(states))
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(m)  # kinds x states numbers

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            total = np.zeros((2 + states + len(m.emit), states))
            for batch in batches:
                start, move, emit, log = Stretches(m, sequences(batch, 0)).expected()
                total[0, 0] += log
                total[1] += start
                total[2 : 2 + states] += move
                total[2 + states :] += emit
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, k]) for k in range(states))], ["row", *(f"s{k}" for k in range(states))])

        got = rows.select("kinds").mapInArrow(run, schema).groupBy("row").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states))).toArrow()
        total = np.zeros((2 + states + v.kinds, states))
        total[got["row"].to_numpy()] = np.stack([got[f"s{k}"].to_numpy() for k in range(states)], axis=1)
        logs.append(float(total[0, 0]))
        start, move = total[1] + 1, total[2 : 2 + states] + 1
        emit = total[2 + states :] + _PRIOR * share[:, None]
        m = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return m, logs


def prepared(docs: DataFrame, stated: int | None = None, kinds: bool = True) -> tuple[Vocabulary, DataFrame, DataFrame]:
    """Of (doc_id, text, held_out): what is learned of words, all rows as a written table, and by row what the rare words add.

    kinds: whether the rows have what the states are learned from.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "held_out")
    learn = docs.where("NOT held_out")
    counts = written(count_words(learn.select("text")))
    v = vocabulary(counts, learn.count(), stated)
    texts = numbered(docs, v) if kinds else numbered(docs, v).drop("kinds", "log_inside")
    rows = written(texts.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row")
    return v, rows, rare.agg(F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"))


def base_columns(v: Vocabulary) -> list[Column | str]:
    """All columns but the model's score, of rows joined with what rare words add."""
    known = F.col("n_known") + F.coalesce("rare_known", F.lit(0))
    base = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(v.log_base())
    return ["doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score")]


def base_all(docs: DataFrame) -> DataFrame:
    """`score_all` without the model: counts only, nothing is fitted."""
    v, rows, rare = prepared(docs, kinds=False)
    return rows.drop("rare").join(rare, "row", "left").select(*base_columns(v))


def score_all(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, stated: int | None = None) -> DataFrame:
    """docs: (doc_id, text, held_out); learns from rows not held out and scores all. Other columns play no part."""
    v, rows, rare = prepared(docs, stated)
    m, _ = baum_welch(rows.where("NOT held_out"), v, states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Stretches(shared.value, sequences(batch, 1)).likelihoods()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["row", "log_kinds"])

    likely = rows.select("row", "kinds").mapInArrow(run, "row long, log_kinds double")
    all_rows = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "log_inside").join(likely, "row").join(rare, "row", "left")
    return all_rows.select(*base_columns(v), (F.col("log_kinds") + F.col("log_inside") + F.coalesce("rare_logs", F.lit(0.0))).alias("score"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", (crc("doc_id", 5) == 1).alias("held_out"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: log10 probabilities of every whole text of documents, learned from rows whose crc32 is not 1 modulo 5."""
    return score_all(_split(spark, sf_dir))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8 SQL can say: all columns but the model's score, base_score to four places."""
    return base_all(_split(spark, sf_dir)).withColumn("base_score", F.round("base_score", 4))


BASE_ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), split AS (
  SELECT doc_id, {crc_sql(5)} = 1 AS held_out FROM documents
), t AS (
  SELECT doc_id, unnest(words) AS word FROM w UNION ALL SELECT doc_id, '' FROM w
), c AS (
  SELECT word, count(*) AS c FROM t JOIN split USING (doc_id) WHERE NOT held_out GROUP BY word
), n AS (
  SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c
)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (word) JOIN split USING (doc_id) CROSS JOIN n GROUP BY doc_id
"""
