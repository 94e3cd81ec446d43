import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
import brute

from siltstone.llm import minhash
from siltstone.llm.components import components
from siltstone.llm.text import shingle_sets, words


def test_words_and_sets():
    texts = ["Hello World", None, "", "a", "b  C\nhello world", " x", "yy", "hello", "É é\x0bz", "a b a b a b a b"]
    got, sizes = [], []
    for w in words(pa.array(texts)):
        got += [[w.text(i).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(w.first) - 1)]
        sizes += np.diff(shingle_sets(w, 3)[1]).tolist()
    assert got == [brute.tokens(t) for t in texts]
    assert sizes == [len(brute.shingles(t, 3)) for t in texts]


def test_partial_keys_collide_as_similarity():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 64, 1500, np.uint64)
    sets, at = np.concatenate([x[:1000], x[500:]]), np.array([0, 1000, 2000])  # similarity 1/3
    keys = minhash.partial_keys(sets, at, 3000, 1, 1)
    assert abs((keys[0] == keys[1]).mean() - 1 / 3) < 0.04


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute.near_duplicates(texts, 4)


def test_chains_ties_and_nulls(spark):
    """A chain whose ends aren't alike, copies, a text without words, null ids, rows that share an id, a long text."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows, text = [], list(base)
    for k in range(12):
        rows.append((100 - k, " ".join(text)))
        text = text[6:] + [f"x{k}_{j}" for j in range(6)]
    rows += [(7, rows[3][1].upper()), (8, " \n"), (9, None), (10, ""), (11, "short"), (12, "SHORT"), (13, "word " * 100_000)]
    whole = [(i, t, "x") for i, t in [*rows, (11, "short"), (None, "short")]]
    df = spark.createDataFrame(whole, "doc_id long, text string, key string")
    out = minhash.near_duplicates(df, shingle=4).collect()
    want = brute.near_duplicates(rows, 4)
    assert len(out) == len(whole)
    for x in out:
        assert x.kept == (x.doc_id == x.component_id)
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert (x.n_shingles, x.component_id) == want[x.doc_id]
    assert want[100][1] == want[89][1] == 7
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 99), (99, 120), (5, 5), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99, 120: 99, 200: 200, 201: 200}


def test_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words collide under every polynomial modulo a power of two."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    w = next(words(pa.array([f"{a} {b} {a}"])))
    assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2]
    out = minhash.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string"), shingle=4)
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 2, 3: 1}


def test_different_words_have_different_hashes():
    r = np.random.default_rng(3)
    own = sorted({bytes(r.integers(97, 99, n).astype(np.uint8)).decode() for n in r.integers(1, 90, 4000)} | {"a" * n for n in range(1, 200)})
    h = np.concatenate([w.hash for w in words(pa.array([" ".join(own)]))])
    assert len(h) == len(own) == len(set(h.tolist()))


def near_misses(n, seed=9):
    """Copies of one text with 12 of 120 words changed: most pairs are alike by about 0.5, some chains by 0.8."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(n):
        text = list(base if k % 5 else rows[-1][1].split() if rows else base)
        for at in r.sample(range(120), 2 if k % 5 == 0 else 9):
            text[at] = f"x{k}_{at}"
        rows.append((k, " ".join(text)))
    r.shuffle(rows)
    return rows


def test_clusters_in_blocks(spark, monkeypatch):
    rows = near_misses(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows, 4)
    for size in (minhash.A_BLOCK, 1500):  # one block, and about ten
        monkeypatch.setattr(minhash, "A_BLOCK", size)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=4).collect()} == want


def test_links_of_a_group_join_all():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 1 << 63, 300, np.uint64))
    for two in (False, True):
        g = minhash.Group()
        for k in range(60):
            g.add(k % 2 if two else 0, k, k, np.unique(np.concatenate([base[k % 7 :], r.integers(0, 1 << 63, 5, np.uint64)])))
        links = list(g.links(80))
        assert len(links) == 59 and {x for pair in links for x in pair} == set(range(60))
