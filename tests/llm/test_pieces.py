import hashlib
import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
MODEL = pieces.Model(pieces._load(pieces.MODEL))
HARD = ["", " ", "  a", "a  b   c ", "▁x ▁▁ y", "日本語 😀 á\n\n\t", "<0x41> <s> </s>", "▁" * 40, " " * 100 + "x" + " " * 37, "x" * 5000, "a" * 10 + " " + "=" * 30, "0x00\x00 z", "ab" * 3000]


@pytest.mark.parametrize("text", HARD)
def test_hard(text):
    ids = next(MODEL.encode_all([text]))
    assert ids == LIBRARY.encode(text) == MODEL.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab thein\n.é▁日😀A=_0"), max_size=40), max_size=5))
def test_as_the_library(texts):
    assert list(MODEL.encode_all(texts)) == [LIBRARY.encode(t) for t in texts]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = pieces.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == LIBRARY.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) and r.round_trip
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_frame(spark):
    rows = [(1, None, 5), (1, None, 5), (2, "", 6), (None, "a b " * 30_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = pieces.decode(pieces.encode(df)).collect()
    assert [(r.doc_id, r.decoded) for r in out] == [(i, t or "") for i, t, _ in rows]
    assert pieces.encode(df.limit(0)).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """Of a protocol buffer message."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(int(value))


def character_map(pairs):
    """A double array by hand: each state of the trie has 256 places of its own."""
    states, texts = {b"": 0}, b""
    for key in pairs:
        for k in range(1, len(key) + 1):
            states.setdefault(key[:k], len(states))
    base = {s: 256 * (k + 1) for s, k in states.items()}
    units = [0] * (256 * (len(states) + 1))
    units[0] = base[b""] << 10
    for s in states:
        if s:
            at = base[s[:-1]] ^ s[-1]
            units[at] |= s[-1] | (at ^ base[s]) << 10
        if s in pairs:
            units[base[s[:-1]] ^ s[-1]] |= 1 << 8
            units[base[s]] = 1 << 31 | len(texts)
            texts += pairs[s].encode() + b"\0"
    trie = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(trie)) + trie + texts


CHARACTERS = {k.encode(): v for k, v in {"Å": "A", "e\u0301": "é", "ﬁ": "fi", "\u3000": " ", "\t": " ", "½": "1 2", "\u200b": "", "ab": "ba", "abcd": "d", "…": "...", "\u00a8": " \u0308", "\u2003": "  "}.items()}


def unigram(characters=True, prefix=True, extra=True, fallback=True):
    """A model file written by hand; scores are exact in single precision."""
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])
    score = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -3.5, "▁a": -3.25, "bab": -4.5, "ba": -3.5, "é": -5.0, "▁fi": -4.0, "f": -4.0, "i": -4.0, "A": -6.0, "▁▁": -7.0, "1": -5.0, ".": -3.0, "...": -9.0, "..": -6.5, "d": -4.0}
    own += [(p, x, 1) for p, x in score.items()] + [("abab", -0.25, 5)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, x) + field(3, kind)) for p, x, kind in own)
    out += field(2, field(3, 1) + field(35, fallback))
    return out + field(3, field(1, b"own") + (field(2, character_map(CHARACTERS)) if characters else b"") + field(3, prefix) + field(4, extra) + field(5, True))


SHAPES = [(c, p, e, f) for c in (True, False) for p in (True, False) for e in (True, False) for f in (True, False)]


@pytest.mark.parametrize("shape", SHAPES)
def test_unigram_with_a_character_map_as_the_library(shape):
    data = unigram(*shape)
    library, m = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Model(data)
    r = random.Random(7)
    parts = ["a", "b", "ab", "abcd", "abc", "e\u0301", "e", "é", "Å", "ﬁ", "fi", " ", "  ", "\u3000", "\t", "½", "\u200b", "…", ".", "\u00a8", "\u2003", "日", "z", "▁", "x" * 3]
    texts = ["", " ", "\u200b", "  \u3000\t", "▁"] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(1500)]
    for t, ids in zip(texts, m.encode_all(texts), strict=True):
        assert m.normalise(t) == library.normalize(t), t
        assert ids == library.encode(t) == m.encode(t), t
        assert m.decode(ids) == library.decode(ids), t


def test_unigram():
    """The cheapest sum of weights wins: against all ways to cut the text."""
    m = pieces.Model(unigram())

    def ways(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in m.id for rest in ways(s[k:])]

    for s in ("▁ab", "▁abab", "▁babab", "▁aabbab", "▁a.....b"):
        cost = lambda path: -sum(m.score[p] for p in path)
        assert cost(next(m.paths([s]))) == min(map(cost, ways(s)))


def test_bpe_weights_leave_one_path():
    """Over all ways to cut short strings into pieces, exactly one has no infinite weight, and the path is that one."""
    texts = ["▁the", "▁there", "▁aaa", "▁thin", "▁0000", "▁==", "▁int", "▁abba"]
    for s in texts:
        ways = [w for w in cuts(s) if all(p in MODEL.id for p in w)]
        finite = []
        for w in ways:
            before, total = "", 0.0
            for p in w:
                MODEL.together.setdefault(p, {})
                total += MODEL.weigh(before, p)
                before = p
            if total < pieces.INFINITE:
                finite.append(w)
        assert finite == [next(MODEL.paths([s]))]


def cuts(s):
    return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) for rest in cuts(s[k:])]


def test_refused():
    user = field(1, field(1, b"<unk>") + field(3, 2)) + field(1, field(1, b"x") + field(3, 4)) + field(3, field(3, 1))
    with pytest.raises(ValueError):
        pieces.Model(user)
