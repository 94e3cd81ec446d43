"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file compiles to three machines. The normaliser is a sequential transducer: its character map is a
double array of states and byte arcs of which the longest match is replaced, and two more states know whether a
blank came last; a space becomes the mark U+2581 and one mark goes in front. The lexicon is an automaton over
characters; each state has the arcs of the pieces that end there. Byte fallback is an arc for each character
that no piece has. A text is composed with them as far as it is read, and the cheapest path in the tropical
semiring (weights add up, the least wins) is its encoding: for every position, the arcs into it are relaxed. In a
unigram model an arc weighs the piece's negative score. In a BPE model states remember the piece they came by, and
an arc weighs 0 if encoding that piece and its own together gives just these two, else infinity. Then exactly one
path is finite, at each position too, and it is what merging by rank gives: a first merge across two of its pieces
would also be made if those two stood alone.

No piece holds a mark behind another character, so a normalised text falls into units, each a run of marks with
what follows up to the next, that are encoded apart and remembered. Null and empty texts have no ids; very long
ones are units like others, read once. Of paths that tie the one with the longer last piece wins, as in the
library. Repeated rows have equal ids; an empty table has none. Texts with the mark itself decode to a space in
its place. Models with user-defined pieces, BPE models with unused ones and pieces across words are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siltstone.llm.text import raw, release

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A task forgets its units beyond so many.
REMEMBERED = 100_000
#: And what it knows of pairs of pieces beyond so many.
PAIRS = 300_000
_UNKNOWN_COST = 10.0
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: numbers, and bytes of the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class _Node:
    """A state of the lexicon: what may come next, and the pieces that end here, the longest first."""

    __slots__ = ("ends", "text", "to")

    def __init__(self, text: str, ends: list) -> None:
        self.text, self.ends, self.to = text, ends, {}


class CharacterMap:
    """The normaliser's double array: arcs by byte from state to state, and what a key's last state is replaced by."""

    def __init__(self, data: bytes) -> None:
        size = int.from_bytes(data[:4], "little")
        self.units = np.frombuffer(data[4 : 4 + size], "<u4").tolist()
        self.texts = data[4 + size :]
        self.plain: set[str] = set()  # characters that begin no key

    def arcs(self, text: str, at: int) -> tuple[int, str | None]:
        """Characters of the longest key at a place and its replacement; (1, None) where there is none."""
        units, found = self.units, (1, None)
        state = units[0] >> 10 << ((units[0] & 512) >> 6)
        for k in range(at, len(text)):
            for byte in text[k].encode("utf-8", "surrogatepass"):
                state ^= byte
                unit = units[state] if state < len(units) else 0
                if unit & 0x800000FF != byte:
                    if k == at:
                        self.plain.add(text[at])
                    return found
                state ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                begin = units[state] & 0x7FFFFFFF
                found = k + 1 - at, self.texts[begin : self.texts.index(b"\0", begin)].decode()
        return found


class Normaliser:
    """From a text to its characters with marks for blanks. extra: leading, trailing and repeated blanks go."""

    def __init__(self, characters: bytes, prefix: bool, extra: bool) -> None:
        self.map = CharacterMap(characters) if characters else None
        self.prefix, self.extra = prefix, extra

    def replaced(self, text: str) -> Iterator[str]:
        at, plain, arcs = 0, self.map.plain if self.map else None, self.map and self.map.arcs
        while at < len(text):
            c = text[at]
            size, new = (1, None) if plain is None or c in plain else arcs(text, at)
            yield c if new is None else new
            at += size

    def __call__(self, text: str) -> str:
        if self.map is None or self.map.plain.issuperset(text):
            if not self.extra:
                body = text
            else:
                body = " ".join(filter(None, text.split(" ")))
        else:
            out, blank = [], self.extra  # the state: whether a blank came last
            for part in self.replaced(text):
                while blank and part[:1] == " ":
                    part = part[1:]
                if part:
                    out.append(part)
                    blank = self.extra and part[-1] == " "
            body = "".join(out)
        body = body.replace(" ", MARK)
        if self.extra:
            if not body:
                return ""
            return ((MARK if self.prefix else "") + body).rstrip(MARK)
        return (MARK if self.prefix else "") + body if text else ""


class Model:
    """What a model file says, compiled."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.unigram, self.byte_fallback, self.prefix, self.extra, characters = True, False, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                own = dict(_fields(value))
                self.unigram = own.get(3, 1) == 1
                self.byte_fallback = bool(own.get(35, 0))
                if own.get(3, 1) not in (1, 2):
                    raise ValueError("only unigram and BPE models")
            elif field == 3:
                own = dict(_fields(value))
                self.prefix, self.extra, characters = bool(own.get(3, 1)), bool(own.get(4, 1)), own.get(2, b"")
                if not own.get(5, 1):
                    raise ValueError("models without marks aren't supported")
        if USER in self.kinds or UNUSED in self.kinds and not self.unigram:
            raise ValueError("models with user-defined pieces, and BPE models with unused ones, aren't supported")
        self.normalise = Normaliser(characters, self.prefix, self.extra)
        self.id = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces across words aren't supported")
        self.score = {p: scores[k] for p, k in self.id.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == BYTE}
        self.out = [self._bytes(k) for k in range(len(self.pieces))]
        self.cost_unknown = _UNKNOWN_COST - min(self.score.values(), default=0.0)
        self.together: dict[str, dict[str, float]] = {}  # weights of BPE arcs, by their piece and the one before
        order = sorted((p for p in self.id if len(p) > 1), key=lambda p: -self.score[p])
        self.rank = {p: r for r, p in enumerate(order)}
        alike = {x for x, y in zip(order, order[1:]) if self.score[x] == self.score[y]} | {y for x, y in zip(order, order[1:]) if self.score[x] == self.score[y]}
        self.tied = frozenset("".join(alike))
        self.begins = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        self.nodes: dict[str, _Node] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.units: dict[str, tuple[int, ...]] = {}

    def _bytes(self, k: int) -> bytes:
        if self.kinds[k] == BYTE:
            return bytes([int(self.pieces[k][3:5], 16)])
        if self.kinds[k] == CONTROL:
            return b""
        return (" ⁇ " if self.kinds[k] == UNKNOWN else self.pieces[k].replace(MARK, " ")).encode()

    # BPE

    def merged(self, symbols: str) -> list[str]:
        """Merging by rank, leftmost first, on a few characters."""
        s, halves = list(symbols), None
        while True:
            best, at = -INFINITE, -1
            for k in range(len(s) - 1):
                score = self.score.get(s[k] + s[k + 1], -INFINITE)
                if score > best:
                    best, at = score, k
            if at < 0:
                self.halves[symbols] = halves if len(s) == 1 and halves else (symbols, symbols)
                return s
            halves = (s[at], s[at + 1])
            s[at : at + 2] = [s[at] + s[at + 1]]

    def weigh(self, a: str, b: str) -> float:
        """The weight of b's arc behind a: 0 if no merge across them comes before one that made them."""
        self.together[b][a] = w = 0.0 if self._stay(a, b) else INFINITE
        return w

    def _stay(self, a: str, b: str) -> bool:
        if not a:
            return self.merged(b) == [b]
        if self.tied.intersection(a) and self.tied.intersection(b):
            return self.merged(a + b) == [a, b]
        rank, halves = self.rank, self.halves
        limit = len(rank) + 1
        while True:
            across, made_a, made_b = rank.get(a + b, limit), rank.get(a, -1), rank.get(b, -1)
            if across < limit:
                return False
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                if a not in halves and self.merged(a) != [a]:
                    raise AssertionError(f"the piece {a!r} isn't what its merges give")
                limit, a = made_a, halves[a][1]
            else:
                if b not in halves and self.merged(b) != [b]:
                    raise AssertionError(f"the piece {b!r} isn't what its merges give")
                limit, b = made_b + 1, halves[b][0]

    # lexicon and paths

    def arcs(self, text: str) -> list[tuple[int, float | dict[str, float], str]]:
        """Arcs of the pieces that end text, the longest first, and of its last character where no piece has it: length, weight, piece."""
        found = [text[k:] for k in range(len(text)) if text[k:] in self.id or k == len(text) - 1]
        if self.unigram:
            return [(len(p), -self.score[p] if p in self.score else self.cost_unknown, p) for p in found]
        return [(len(p), self.together.setdefault(p, {}), p) for p in found]

    def step(self, node: _Node, c: str) -> _Node:
        """The state behind the longest end of what was read that begins some piece."""
        text = node.text + c
        while text and text not in self.begins:
            text = text[1:]
        if text or c not in self.nodes:
            self.nodes[text or c] = self.nodes.get(text or c) or _Node(text, self.arcs(text or c))
        node.to[c] = own = self.nodes[text or c]
        return own

    def paths(self, strings: list[str]) -> Iterator[list[str]]:
        """The cheapest path of each string. Strings in ascending order keep what they share with the one before.

        Composed states are places in the string, of a BPE model with the piece that ends there: the others are infinite.
        """
        before, far, ends, nodes, weigh, unigram = "", [0.0], [""], [_Node("", [])], self.weigh, self.unigram
        for s in strings:
            n = len(s)
            k, most = 0, min(len(before), n)
            while k < most and before[k] == s[k]:
                k += 1
            del far[k + 1 :], ends[k + 1 :], nodes[k + 1 :]
            node = nodes[k]
            for to in range(k + 1, n + 1):
                node = node.to.get(s[to - 1]) or self.step(node, s[to - 1])
                nodes.append(node)
                best, end = INFINITE, ""
                if unigram:
                    for size, weight, p in node.ends:
                        d = far[to - size] + weight
                        if d < best:
                            best, end = d, p
                else:
                    for size, weights, p in node.ends:
                        last = ends[to - size]
                        w = weights.get(last)
                        d = far[to - size] + (weigh(last, p) if w is None else w)
                        if d < best:
                            best, end = d, p
                            break  # no weight is less than 0
                if not end:
                    raise AssertionError(f"no path through {s[:to]!r}")
                far.append(best)
                ends.append(end)
            path = []
            while n:
                p = ends[n]
                path.append(p)
                n -= len(p)
            path.reverse()
            before = s
            yield path

    def ids_of(self, path: list[str]) -> tuple[int, ...]:
        try:
            return tuple([self.id[p] for p in path])
        except KeyError:
            out: list[int] = []
        for p in path:
            if p in self.id:
                out.append(self.id[p])
            elif self.byte_fallback:
                out += [self.byte[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def learn(self, keys: set[str]) -> None:
        """Remembers the ids of a mark and each key."""
        new = sorted(MARK + k for k in keys.difference(self.units))
        for s, path in zip(new, self.paths(new), strict=True):
            self.units[s[1:]] = self.ids_of(path)

    def split(self, text: str) -> list[str] | None:
        """Keys of the units of a text whose normalised blanks are single and inside."""
        text = self.normalise(text)
        if not text or not self.prefix or MARK + MARK in text or text[0] != MARK or text[-1] == MARK:
            return None
        return text[1:].split(MARK)

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        if len(self.units) > REMEMBERED:
            self.units.clear()
        if sum(map(len, self.together.values())) > PAIRS:
            for fits in self.together.values():
                fits.clear()
        parts = [self.split(t or "") for t in texts]
        self.learn(set(chain.from_iterable(x for x in parts if x)))
        for t, keys in zip(texts, parts, strict=True):
            if keys:
                yield list(chain.from_iterable(map(self.units.__getitem__, keys)))
            else:
                yield self.encode(t or "")

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        units = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", self.normalise(text))
        new = sorted(set(units))
        known = {s: self.ids_of(path) for s, path in zip(new, self.paths(new), strict=True)}
        return list(chain.from_iterable(map(known.__getitem__, units)))

    def decode(self, ids: list[int]) -> str:
        k, first = 0, b""
        while k < len(ids) and not first and (self.prefix or self.extra):  # a mark in front isn't of the text
            first = self.out[ids[k]]
            seen = first[:1] == b" " and self.kinds[ids[k]] == NORMAL
            first, k = first[seen:], k + 1
            if seen and not self.extra:
                break
        return (first + b"".join(map(self.out.__getitem__, ids[k:]))).decode("utf-8", "replace")


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids") -> DataFrame:
    """docs with a column of piece ids; no shuffle. Columns of that name are replaced."""
    keep = docs.select([c for c in docs.columns if c != ids])
    data = keep.sparkSession.sparkContext.broadcast(_load(model))  # a vocabulary, about half a megabyte
    schema = T.StructType([*keep.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = Model(data.value)
        for whole in batches:
            k = whole.schema.get_field_index(text)
            for batch in _bounded(whole, k):
                out, at = [], np.zeros(batch.num_rows + 1, np.int32)
                for r, found in enumerate(m.encode_all(batch.column(k).to_pylist())):
                    out.append(np.array(found, np.int32))
                    at[r + 1] = at[r] + len(out[-1])
                col = pa.ListArray.from_arrays(at, np.concatenate(out))
                yield pa.RecordBatch.from_arrays([*batch.columns, col], [*batch.schema.names, ids])
            whole = batch = out = col = None
            release()

    return keep.mapInArrow(run, schema)


def decode(docs: DataFrame, ids: str = "ids", model: str = MODEL, text: str = "decoded") -> DataFrame:
    """docs with the text of a column of ids (null: empty); ids that the model lacks are an error."""
    keep = docs.select([c for c in docs.columns if c != text])
    data = keep.sparkSession.sparkContext.broadcast(_load(model))
    schema = T.StructType([*keep.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(data.value)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.decode(x or []) for x in rows], pa.string())], [*batch.schema.names, text])

    return keep.mapInArrow(run, schema)


def _load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _bounded(batch: pa.RecordBatch, k: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    _, at = raw(batch.column(k))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """op1: ids of every whole text of documents, and the digest of what they decode to, in one pass."""
    from siltstone.llm.tables import table

    data = spark.sparkContext.broadcast(_load(model))
    schema = "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = Model(data.value)
        for whole in batches:
            for batch in _bounded(whole, 1):
                out, at, digests, same = [], np.zeros(batch.num_rows + 1, np.int32), [], []
                texts = batch.column(1).to_pylist()
                for r, (t, ids) in enumerate(zip(texts, m.encode_all(texts), strict=True)):
                    out.append(np.array(ids, np.int32))
                    at[r + 1] = at[r] + len(ids)
                    back = m.decode(ids)
                    same.append(back == (t or ""))
                    digests.append(hashlib.sha256(back.encode()).hexdigest())
                col = pa.ListArray.from_arrays(at, np.concatenate(out))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), col, pa.array(digests), pa.array(same)], ["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"])
            release()

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, schema)
