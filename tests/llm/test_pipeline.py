import re
import sys
from pathlib import Path

import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import brute
import corpus_pipeline
import sentencepiece
from test_decontaminate import brute as contaminated
from test_secrets import brute as spans

from siltstone.llm import pieces, toxicity
from siltstone.llm.tables import table

WORDS = re.compile("[a-z0-9\x80-\U0010ffff]+")
SF = "/root/testdata/sf0.001"


def test_against_plain_version(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = {r.doc_id: r for r in docs.collect()}

    def score(text):
        return max(p[0] for _, p, _ in toxicity.scored(model, pa.array([text])))

    kept = [(k, r.text) for k, r in rows.items() if score(r.text) < toxicity.CUTOFF]
    groups = brute.near_duplicates(kept, 5)
    kept = [(k, t) for k, t in kept if groups[k][1] == k]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    said = {i: set(zip(w, w[1:], w[2:], w[3:], w[4:])) for i, t in items for w in [WORDS.findall(t.lower())]}
    near = [(k, t) for k, t in kept for w in [WORDS.findall(t.lower())] if any(len(s.intersection(zip(w, w[1:], w[2:], w[3:], w[4:]))) * 2 > len(s) for s in said.values())]
    held = {k for k, _ in contaminated(near, items)}
    want = {}
    for k, t in kept:
        if k not in held:
            out, at = "", 0
            for kind, a, b in spans(t):
                if a >= at:
                    out += t[at:a] + f"[{kind}]"
                at = max(at, b)
            want[k] = out + t[at:]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want) and 0 < len(want) < len(rows)
    for k, t in want.items():
        r = got[k]
        assert (r.text, r.n_chars, r.lang, r.source) == (t, len(t), rows[k].lang, rows[k].source)
        assert r.ids == library.encode(t) and r.n_pieces == len(r.ids)


def test_odd_rows(spark):
    """Null ids and texts, repeated ids and rows, and columns more whose names the stages use themselves."""
    text, other = (" ".join(f"{w}{k}" for k in range(60)) for w in ("word", "else"))
    rows = [(1, text, 0), (1, text, 0), (2, text, 1), (3, None, 2), (None, text, 3), (4, "", 4), (5, other, 5), (5, other + " " + other[::-1], 6), (None, "short one", 7), (None, None, 8)]
    docs = spark.createDataFrame([(i, t, "en", "s", 3, k, k, k, k) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, ids int, row int, _row int, component int")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "pieces":
            assert docs.columns == names
    got = sorted((r.doc_id or 0, r.row if r.doc_id != 1 else 0, len(r.ids)) for r in docs.collect())
    want = [(1, 0, r_len(text)), (3, 2, 0), (4, 4, 0), (5, 5, r_len(other)), (5, 6, r_len(other + " " + other[::-1])), (0, 7, r_len("short one")), (0, 8, 0)]
    assert got == sorted(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def r_len(text):
    return len(sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text))
