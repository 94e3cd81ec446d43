"""Secret scans: one minimal deterministic automaton of all rules reads every byte once.

The automaton reads backwards, so its accepting states say at each byte which rules have a match that begins
there. Texts are cut behind bytes that lead every state back to the start, which no match can hold, and the
pieces walk through the transition array side by side, long ones on their own. A span begins at a rule's first
mark behind its span before, and only its own bytes are read once more, for its end: leftmost, longest, not
overlapping within a kind. So all is linear in the text, however often a rule's beginning is repeated.

Null and empty texts have no spans; repeated rows give the same spans; ties of place go by the order of rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.automaton import Longest, compile_rules, resetting
from siltstone.llm.text import chunks, release


class Rule(NamedTuple):
    """head is read first, then body; a match counts with `body_least` bytes of body or more, `least` in all."""

    kind: str
    head: str
    body: str
    body_least: int = 1
    least: int = 0
    base: bool = True
    #: What begins where a match that counts begins, if a match that doesn't count never hides one that does.
    mark: str | None = None


RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", "AKIA", "[A-Z0-9]+", least=18, mark="AKIA[A-Z0-9]{14}"),
    Rule("hex", "", "[0-9a-f]+", 16, mark="[0-9a-f]{16}"),
    Rule("github", "gh[opsur]_", "[A-Za-z0-9]+", 36, base=False),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35, base=False),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10, base=False),
    Rule("pem", "-----BEGIN ", "[A-Z ]*PRIVATE KEY-----", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", 8, base=False),
)

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PIECES = 1 << 21
#: Pieces that walk side by side, at least; fewer walk one by one.
_ABREAST = 48


class Scanner:
    """Compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        m = compile_rules([r.mark or r.head + r.body for r in rules], search=True, backwards=True)
        order = np.argsort([bool(a) for a in m.accepts], kind="stable")  # states that accept come last, the start stays first
        number = np.argsort(order)
        table = number[m.next.reshape(-1, m.n_classes)[order]].astype(np.int32)
        self.cuts, self.classes, self.width = resetting(m), m.classes, m.n_classes
        self.first_mark = sum(not a for a in m.accepts)
        self.next = (table * self.width).reshape(-1)  # states are places of their rows
        self.rows = table[:, m.classes].tolist()
        self.marks = np.array([[k in m.accepts[q] for k in range(len(rules))] for q in order[self.first_mark :]]).reshape(-1, len(rules))
        self.ends = [(Longest(compile_rules([r.head], False)) if r.head else None, Longest(compile_rules([r.body], False))) for r in rules]

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which rules have matches, ascending, and their marking states (from 0)."""
        cut = np.flatnonzero(self.cuts[data]) + 1
        edge = np.union1d(cut, offsets)
        start, end = edge[:-1], edge[1:]
        if not len(start):
            return start, start
        order = np.argsort(start - end, kind="stable")
        start, end = start[order], end[order]
        size = end - start
        classes = self.classes[data]
        state = np.zeros(len(start), np.int32)
        steps = int(size[_ABREAST - 1]) if len(size) >= _ABREAST else 0
        live = len(start) - np.searchsorted(size[::-1], np.arange(steps), "right")  # pieces longer than t
        least, found = self.first_mark * self.width, []
        for t, n in enumerate(live.tolist()):
            at = end[:n] - (t + 1)
            q = state[:n] = self.next[state[:n] + classes[at]]
            if q.max() >= least:
                hit = np.flatnonzero(q >= least)
                found.append((at[hit], q[hit] // self.width))
        for k in range(int(np.searchsorted(-size, -steps, "left"))):
            found.append(self._alone(data[start[k] : end[k] - steps].tobytes(), int(start[k]), int(state[k]) // self.width))
        if not found:
            return start[:0], start[:0]
        at, q = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], q[order] - self.first_mark

    def _alone(self, data: bytes, base: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        rows, least, at, states = self.rows, self.first_mark, [], []
        row = rows[q]
        for k in range(len(data) - 1, -1, -1):
            q = row[data[k]]
            if q >= least:
                at.append(base + k)
                states.append(q)
            row = rows[q]
        return np.array(at, np.int64), np.array(states, np.int64)

    def spans(self, data: bytes, at: np.ndarray, state: np.ndarray) -> list[tuple[int, int, int, str]]:
        """(start, rule, end, kind) in bytes of one text, by start and then rule; at and state as from `starts`."""
        found = []
        marks = self.marks[state]
        for k in np.flatnonzero(marks.any(axis=0)).tolist():
            rule, (head, body), last = self.rules[k], self.ends[k], 0
            for s in at[marks[:, k]].tolist():
                if s < last:
                    continue
                inner = head.end(data, s) if head else s
                end = body.end(data, inner) if inner >= 0 else -1
                if end <= inner:
                    continue
                if end - inner >= rule.body_least and end - s >= rule.least:
                    found.append((s, k, end, rule.kind))
                last = end
        return sorted(found)

    def column(self, texts: pa.Array) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end in code points) of every row."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
        for lo, _, data, offsets in chunks(texts, _PIECES):
            at, state = self.starts(data, offsets)
            row = np.searchsorted(offsets, at, "right") - 1
            edge = np.flatnonzero(np.diff(row, prepend=-1, append=len(offsets)))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                r = int(row[a])
                base, own = int(offsets[r]), data[offsets[r] : offsets[r + 1]]
                found = self.spans(own.tobytes(), at[a:b] - base, state[a:b])
                if found:
                    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    out[lo + r] = [(kind, int(points[s]), int(points[e])) for s, _, e, kind in found]
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """docs with a column `name`: array of (kind, start, end), code points, end exclusive, by start and then rule.

    No shuffle. A column of that name is replaced.
    """
    keep = [c for c in docs.columns if c != name]
    machine = scanner(rules)
    schema = T.StructType([*docs.select(keep).schema.fields, T.StructField(name, SPANS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = machine.column(batch.column(batch.schema.get_field_index(text)))
            col = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, col], [*batch.schema.names, name])

    return docs.select(keep).mapInArrow(scan, schema)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by [kind]; overlapping spans become one, named by the first. n_chars follows, where there is one."""
    machine = scanner(rules)

    def cover(t: str, spans: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for kind, s, e in spans:
            if s >= at:
                out += [t[at:s], f"[{kind}]"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text)
            col = batch.column(k)
            found = machine.column(col)
            if any(found):
                hit = [r for r, spans in enumerate(found) if spans]
                mask = np.zeros(len(col), bool)
                mask[hit] = True
                new = pa.array([cover(col[r].as_py(), found[r]) for r in hit], col.type)
                arrays = list(batch.columns)
                arrays[k] = pa.compute.replace_with_mask(col, pa.array(mask), new)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch
        release()

    out = docs.mapInArrow(scan, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


BASE_KINDS = tuple(r.kind for r in RULES if r.base)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: counts of the base kinds, the digest of their spans, and all spans, of every whole text of documents."""
    from siltstone.llm.tables import table

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def _oracle() -> str:
    """Matches from one regex function, what lies between them from another: together they give the places."""
    size = "lambda x: length(x)"
    parts = []
    for k, r in enumerate(RULES):
        head = r.head.replace("(?i:password|passwd|secret|token|api_?key)", "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
        regex = f"{head}({r.body})".replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {k} AS nr, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'a': coalesce(list_sum(list_transform(p[1:i], {size})), 0) + coalesce(list_sum(list_transform(m[1:i - 1], {size})), 0), 'n': length(m[i]), 'body': length(g[i])}})) AS x,
    {r.body_least} AS body_least, {r.least} AS least
  FROM (SELECT doc_id, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', 1) AS g, string_split_regex(t, '{regex}') AS p FROM d)""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(parts)}
), spans AS (
  SELECT doc_id, nr, kind, x.a::BIGINT AS a, kind || ':' || x.a::BIGINT || ':' || (x.a + x.n)::BIGINT AS span FROM found WHERE x.body >= body_least AND x.n >= least
), by_doc AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
    string_agg(span, ',' ORDER BY a, nr) FILTER (nr < {len(BASE_KINDS)}) AS base, string_agg(span, ',' ORDER BY a, nr) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (doc_id)
"""


ORACLE = _oracle()
