import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import sampling

SF = "/root/testdata/sf0.001"


def edited(texts):
    """By position, in the order of the contract."""
    out = []
    for k, t in enumerate(texts):
        n = len(t) // 3
        out.append(t[: len(t) - n] + texts[(k + 1) % len(texts)][:n])
    return out


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    return sum((a & b).values()) / max(sum((a | b).values()), 1) if a or b else 1.0


def test_query(spark):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in sampling.query(spark, SF).collect()}
    texts = [t for _, t in rows]
    change = edited(texts)
    wrong = [0.0, 0.0]
    for k, (d, t) in enumerate(rows):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(change[k].encode()).hexdigest())
        for j, (seen, other) in enumerate(((r.near_edited, change[k]), (r.near_next, texts[(k + 1) % len(rows)]))):
            wrong[j] += seen - jaccard(t, other)
            assert abs(seen - jaccard(t, other)) < 0.3
    assert all(abs(w) / len(rows) < 0.02 for w in wrong)
    assert len(got) == len(rows)
    prints = {}
    for d, t in rows:
        prints.setdefault(t, set()).add(got[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


@pytest.mark.parametrize("bucket", [2, 512])
def test_odd_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(sampling, "A_BUCKET", bucket)
    rows = [(10**15, "é" * 10), (7, "a b c d e f"), (7, "a b c d e f"), (5, None), (4, ""), (-3, "x " * 30_000), (None, "z z z"), (None, "z a z"), (3, "f e d c b a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    hashed = {t: h for t, h in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""], r[1] or ""), reverse=True)
    texts = [t or "" for _, t in order]
    want = sorted((str(d), len(t), hashlib.sha256(e.encode()).hexdigest()) for (d, _), t, e in zip(order, texts, edited(texts), strict=True))
    out = sampling.fingerprints(df).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == want
    sig = {(r.doc_id, r.n_chars): r for r in out}
    assert sig[5, 0].sig == sig[4, 0].sig == [0] * sampling.SAMPLES and sig[5, 0].next_sig == sig[4, 0].sig
    assert sig[7, 11].sig == sig[3, 11].sig and 0 not in sig[7, 11].sig  # the same words in another order
    assert sig[4, 0].next_sig == sig[3, 11].sig and sig[3, 11].next_sig == sig[-3, 60_000].sig
    assert sampling.fingerprints(df.limit(0)).count() == 0
    one = sampling.fingerprints(df.limit(1)).first()
    assert one.sig == one.next_sig


def test_plan_is_native(spark):
    plan = sampling.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_buckets_are_even_whatever_the_ids(spark):
    """Ids in a heap, one far away, and as many null ids: no bucket has many of the rows, and their order is that of the rows."""
    ids = [*range(4000), 10**15, -(10**15), *[None] * 3000, *[7] * 1000]
    df = spark.createDataFrame([(d, k * 7919) for k, d in enumerate(ids)], "doc_id long, hash long")
    rows = sorted(((r.doc_id, r.hash, r.bucket) for r in sampling.bucketed(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    buckets = [b for *_, b in rows]
    assert buckets == sorted(buckets) and len(rows) == len(ids)
    sizes = Counter(buckets)
    assert len(sizes) > 10 and max(sizes.values()) < 4 * sampling.A_BUCKET


def test_signature_is_the_least_of_plain_values(spark):
    """A document's samples, worked out term by term from the formula, with the hashes taken from Spark."""
    counts = Counter("a b c a d a b".split())
    rows = spark.createDataFrame([(w, n) for w, n in counts.items()], "w string, n int").selectExpr("xxhash64(w) AS term", "n")
    want = []
    for group in range(sampling.SAMPLES // sampling.A_GROUP):
        for j in range(sampling.A_GROUP):
            hashes = rows.selectExpr("n", f"xxhash64(term, {group}, {2 * j}) AS x", f"xxhash64(term, {group}, {2 * j + 1}) AS y").collect()
            least = []
            for n, x, y in hashes:
                part = lambda h, at, bits: ((h % 2**64) >> at & (1 << bits) - 1) + 0.5
                r = -math.log(part(x, 0, 21) / 2**21) - math.log(part(x, 21, 21) / 2**21)
                c = -math.log(part(y, 0, 31) / 2**31) - math.log(part(y, 31, 31) / 2**31)
                b = part(x, 42, 21) / 2**21
                least.append(math.log(c) - r * (math.floor(math.log(n) / r + b) - b + 1))
            want.append(min(least))
    got = spark.createDataFrame([(1, "a b c a d a b")], "doc_id long, text string")
    sig = sampling.fingerprints(got).first().sig
    values = rows.select(*(F.min(sampling.value(F.col("term"), F.lit(g), j, F.ln(F.col("n").cast("double")))) for g in range(4) for j in range(16))).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(values, want, strict=True))
    assert sig == [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").selectExpr("hash(v)").collect()]


def evaluated(spark, docs, known):
    """Rows of terms in docs whose values are not in the table, of all."""
    words = docs.select("doc_id", sampling.word_terms("text").alias("word")).where("word != ''")
    terms = words.groupBy("doc_id", F.xxhash64("word").alias("term")).agg(F.count("*").alias("weight")).withColumn("key", sampling.pair(F.col("term"), F.col("weight")))
    return terms.join(known, "key", "left").agg(F.sum(F.col("known").isNull().cast("int")), F.count("*")).first()


def test_values_of_frequent_terms_are_worked_out_once(spark, monkeypatch):
    """Even of a small table a quarter of the rows find their values in the table, which is no larger than asked for and changes no result."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known = sampling.known_values(docs).cache()
    left, n = evaluated(spark, docs, known)
    assert left < 0.75 * n and known.count() <= sampling.KNOWN
    term, w = F.col("of_term"), F.log(F.col("w").cast("double"))
    rows = known.limit(300).withColumn("w", F.shiftrightunsigned(F.col("key").bitwiseXOR(term), 40) + 1)
    assert rows.where("w > 1").count() > 0
    plain = [sampling.value(term, F.lit(g), j, w) for g in range(sampling.SAMPLES // sampling.A_GROUP) for j in range(sampling.A_GROUP)]
    assert all(r.known == r.plain for r in rows.select("known", F.array(*plain).alias("plain")).collect())

    few = docs.orderBy("doc_id").limit(300).union(spark.createDataFrame([(-1, "of " * 70_000), (-2, None)], docs.schema)).cache()
    results = []
    for size in (sampling.KNOWN, 5, 0):
        monkeypatch.setattr(sampling, "KNOWN", size)
        results.append(sorted(map(str, sampling.fingerprints(few).collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == 302


def test_weights_that_do_not_fit_have_no_key(spark):
    """A weight of 2**24 + 1 must not be taken for weight 1."""
    rows = spark.createDataFrame([(77, w) for w in (1, 2, 1 << 24, (1 << 24) + 1)], "term long, weight long")
    keys = [r[0] for r in rows.orderBy("weight").select(sampling.pair(F.col("term"), F.col("weight"))).collect()]
    assert keys[0] == 77 and keys[3] is None and len({*keys[:3]}) == 3
