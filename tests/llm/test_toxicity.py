import random

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import toxicity


def made(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        toxic = r.random() < 0.3
        sentences = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(1, 12))]
        if toxic:
            at = r.randrange(len(sentences))
            sentences[at] += " " + r.choice(["Vile", "rotten,", "foul"])
        docs.append((k, ". ".join(sentences) + ".", "en"))
        labels.append((k, int(toxic), None))
    return docs, labels


def test_learns_from_documents_and_finds_sentences(spark):
    docs, labels = made(900, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic_score string")
    t = spark.createDataFrame([*labels, (None, 1, None), (5, None, None), (10**9, 1, None)], "doc_id long, toxic int, quality int")
    model = toxicity.train(d.drop("toxic_score"), t.where("doc_id < 600 OR doc_id IS NULL"))
    got = {r.doc_id: r for r in toxicity.locate(toxicity.score(d, model), model).collect()}
    for (k, text, _), (_, toxic, _) in zip(docs[600:], labels[600:]):
        assert (got[k].toxic_score >= 0.7) == bool(toxic)
        spans = [text[s.start : s.end].lower() for s in got[k].offending]
        assert len(spans) == toxic and all(any(w in x for w in ("vile", "rotten", "foul")) for x in spans)
    kept = {r.doc_id for r in toxicity.reject(d, model).collect()}
    assert kept == {k for k, r in got.items() if r.toxic_score < 0.7}


def test_edges(spark):
    docs, labels = made(60, 2)
    d = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "... !"), (3, "vile " * 50_000), (4, "é vile\nfine")], "doc_id long, text string")
    flat = toxicity.fit([])
    assert [r.toxic_score for r in toxicity.score(d, flat).collect()] and toxicity.score(d.limit(0), flat).count() == 0
    one_kind = toxicity.fit([(0, np.array([1], np.int32), np.array([1], np.int32))])
    scores = {r.toxic_score for r in toxicity.score(d.where("doc_id < 3"), one_kind).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 0.7
    assert toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int")).weights.sum() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.query(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in own) / len(own) > 0.9
    assert not any(p and not t for p, t in own)


def test_length_alone_is_not_toxic(spark):
    docs, labels = made(900, 1)
    d = spark.createDataFrame([k[:2] for k in docs], "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame([k[:2] for k in labels], "doc_id long, toxic int"))
    clean = "".join(f"w{k % 300} w{k * 7 % 300}.\n" for k in range(50_000))
    long = spark.createDataFrame([(1, clean), (2, "plain.\n" * 50_000), (3, clean + "a vile w1."), (4, "a vile w1.")], "doc_id long, text string")
    got = {r.doc_id: r.toxic_score for r in toxicity.score(long, model).collect()}
    assert max(got[1], got[2]) < 0.2 and min(got[3], got[4]) >= 0.7
    assert {r.doc_id for r in toxicity.reject(long, model).collect()} == {1, 2}


def test_forms_never_seen(spark):
    docs, labels = made(400, 3)
    docs = [(k, text.lower().replace("vile", f"grumoste{k}").replace("rotten", f"grumoste{k}x").replace("foul", f"grumoste{k}y")) for k, text, _ in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([k[:2] for k in labels], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic_score for r in toxicity.score(d, toxicity.train(d, t.where("doc_id < 300"))).collect()}
    assert all((got[k] >= 0.7) == bool(toxic) for k, toxic, _ in labels[300:])


def test_held_out_by_language(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r.predicted for r in toxicity.query(spark, sf).where("held_out").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    caught, flagged = {}, []
    for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IN (0, 1)").collect():
        if r.doc_id in got:
            (caught.setdefault(lang[r.doc_id], []) if r.toxic else flagged).append(got[r.doc_id])
    shares = {k: (sum(v), len(v)) for k, v in caught.items()}
    print(shares, sum(flagged), len(flagged))
    least = {"en": 0.85, "fr": 0.75, "de": 0.7, "es": 0.7}
    assert all(shares[k][0] >= x * shares[k][1] for k, x in least.items()), shares
    assert sum(flagged) <= 0.01 * len(flagged)


def plain_score(model, text):
    """Noisy-or as it is written down: sentence by sentence, feature by feature."""
    import math
    import re

    quiet = math.log1p(math.exp(model.bias))
    for sentence in re.split(r"[.!?\n]", text):
        found = {w.encode().lower() for w in re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", sentence)}
        forms = found | {(w, n) for w in found for n in toxicity.PREFIXES if len(w) > n}
        buckets = set()
        for f in forms:
            w, n = (f, None) if isinstance(f, bytes) else f
            for s in toxicity.sentences(pa.array([w.decode()])):
                own = list(toxicity.features(s.w))
                buckets.add(int(own[0][1][0]) if n is None else int(own[1 + toxicity.PREFIXES.index(n)][1][0]))
        score = model.bias + sum(float(model.weights[b]) for b in buckets)
        quiet += max(math.log1p(math.exp(score)) - math.log1p(math.exp(model.bias)), 0)
    return -math.expm1(-quiet)


def rows_of(docs, labels):
    out = []
    for (_, text, *_), (_, toxic, *_) in zip(docs, labels):
        for s in toxicity.sentences(pa.array([text])):
            at, bucket = toxicity.by_sentence(s)
            out.append((toxic, bucket.astype(np.int32), np.bincount(at, minlength=len(s.first) - 1).astype(np.int32)))
    return out


def test_score_is_the_noisy_or_and_its_gradient_is_right():
    docs, labels = made(150, 4)
    rows = rows_of(docs, labels)
    model = toxicity.fit(rows)
    texts = [d[1] for d in docs[:40]] + ["", "Vile vile é VILE!", "a.b\nc"]
    got = np.concatenate([p for _, p, _ in toxicity.scored(model, pa.array(texts))])
    assert np.allclose(got, [plain_score(model, t) for t in texts])

    b, r = toxicity.bags(rows), np.random.default_rng(0)
    w, bias = r.normal(0, 0.5, len(b.buckets)), -2.0
    g = b.gradient(w, bias)
    for k in [*r.integers(0, len(w), 20).tolist(), len(w)]:
        step = np.zeros(len(w) + 1)
        step[k] = 1e-6
        up, down = (b.likelihood((np.append(w, bias) + x)[:-1], (np.append(w, bias) + x)[-1]) for x in (step, -step))
        assert abs((up - down) / 2e-6 - g[k]) < 1e-4


def test_small_gradients_stay_zero():
    """Under the L1 penalty alone, weights are zero exactly where the gradient is within it."""
    rows = rows_of(*made(300, 6))
    b = toxicity.bags(rows)
    w, bias = toxicity.ascend(b, np.zeros(len(b.buckets)), -3.0, toxicity.L1, 0.0, 600)
    g = b.gradient(w, bias)[:-1]
    assert 0 < (w != 0).sum() < len(w) / 20
    assert np.abs(g[w == 0]).max() < 1.1 * toxicity.L1


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.6), ("sf0.01", 0.9)])
def test_held_out_order(spark, sf, least):
    """Of a toxic and a clean held-out row, the toxic one scores higher so often."""
    sf = f"/root/testdata/{sf}"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, labels[r.doc_id]) for r in toxicity.query(spark, sf).where("held_out").collect() if labels.get(r.doc_id) is not None]
    high, low = ([s for s, t in got if t == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in high for b in low]) >= least


def test_sample_is_bounded_by_bytes(spark):
    docs, labels = made(200, 5)
    d = spark.createDataFrame([*[x[:2] for x in docs], (999, "vile " * 30_000)], "doc_id long, text string")
    t = spark.createDataFrame([*[x[:2] for x in labels], (999, 1)], "doc_id long, toxic int")
    assert (toxicity.train(d, t, sample_bytes=60_000).weights != 0).any()
    assert not (toxicity.train(d, t, sample_bytes=0).weights != 0).any()
