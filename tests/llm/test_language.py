import re
import tracemalloc

import numpy as np
import pyarrow as pa

from siltstone.llm import language
from siltstone.llm.tables import crc

EN = "the weather in the north was cold and they walked home through the evening rain with their dogs "
FR = "la maison est dans une rue calme et les enfants jouent avec leurs amis pendant que le soir tombe "


def model(spark, **more):
    rows = [(EN * 5, "en"), (FR * 5, "fr"), (None, "xx"), ("unused", None), *((t, k) for k, t in more.items())]
    return language.train(spark.createDataFrame(rows, "text string, lang string"))


def test_mixture_and_edges(spark):
    m = model(spark)
    assert m.languages == ["en", "fr"]
    texts = [EN, FR, EN * 3 + FR, None, "", " 12 34 !", "é", EN.upper(), FR * 3000, EN]
    df = spark.createDataFrame([(k, t, "zz") for k, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    out = {r.doc_id: r for r in language.identify(df, m, "doc_id").collect()}
    assert [out[k].lang_pred for k in range(10)] == ["en", "fr", "en", "und", "und", "und", out[6].lang_pred, "en", "fr", "en"]
    assert [x.lang for x in out[2].languages] == ["en", "fr"] and abs(out[2].languages[0].share - 0.75) < 0.08
    assert [x.lang for x in out[8].languages] == ["fr"]
    assert all(0 <= r.score <= 1 for r in out.values()) and out[3].score == 0
    assert language.identify(df.limit(0), m, "doc_id").count() == 0


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    df = spark.createDataFrame([(1, EN)], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.identify(df, language.train(empty), "doc_id").collect()] == [("und", 0.0)]


def test_counts_and_likelihoods(spark):
    """Against trigrams taken one by one."""
    m = model(spark)

    def one(word):
        b = [32, *word.encode(), 32]
        return [((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 16 for x, y, z in zip(b, b[1:], b[2:])]

    counts = np.full((language.BUCKETS, 2), language.SMOOTHING)
    for k, t in enumerate((EN * 5, FR * 5)):
        for w in t.split():
            np.add.at(counts[:, k], one(w), 1)
    assert np.allclose(m.log_p, np.log(counts / counts.sum(axis=0)), atol=1e-5)
    texts = ["The rain, été", "", "a"]
    data, at = language.chunks(pa.array(texts)).__next__()[2:]
    got, first = language.word_likelihoods(m, data, at)
    words = [w for t in texts for w in re.findall("[a-zé]+", t.lower())]
    assert first.tolist() == [0, 3, 3, 4]
    assert np.allclose(got, [m.log_p[one(w)].sum(axis=0) for w in words], atol=1e-3)


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", (crc("doc_id", 4) == 2).alias("out"))
    got = language.query(spark, sf).join(docs, "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == r.out for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in own) / len(own) > 0.95


def test_a_long_text_in_pieces_is_as_a_whole():
    """Proportions, set and sureness of one text read in pieces, against the same text at once; pieces end between words."""
    r = np.random.default_rng(1)
    m = language.Model(["a", "b", "c"], np.log(r.dirichlet(np.full(language.BUCKETS, 0.3), 3).T).astype(np.float32))
    for text in (EN * 30 + FR * 20, EN * 9, "x", " ... ", "é" * 300 + " a b"):
        data = np.frombuffer(text.encode(), np.uint8)
        shares, sure = language.infer(m, data, np.array([0, len(data)]))
        got = language.infer_long(m, data, 700)
        assert np.allclose(got[0], shares[0]) and np.isclose(got[1], sure[0])
        assert [k for a, b in language.cuts(data, 700) for k in range(a, b)] == list(range(len(data)))


def test_memory_is_bounded(spark, monkeypatch):
    """Twenty megabytes of letters without a blank, and as many with them, in pieces."""
    monkeypatch.setattr(language, "A_PIECE", 1 << 18)
    m = model(spark)
    tracemalloc.start()
    for text in (EN.replace(" ", "") * 25_000, EN * 20_000):
        data = np.frombuffer(text.encode(), np.uint8)
        shares, _ = language.infer_long(m, data, (1 << 18) // 2)
        assert shares.argmax() == 0
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_mixture_against_plain_expectation_maximisation():
    """Rows together in arrays, against one row and one word at a time; and no proportions beat the headroom."""
    r = np.random.default_rng(2)
    size = np.array([5, 1, 40])
    p = r.random((46, 4)) ** 4
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    allowed = np.array([[1, 1, 1, 1], [1, 0, 1, 0], [1, 1, 0, 0]], float)
    share, fit = language.mixture(p, first, size, allowed, rounds=6)
    for k in range(3):
        own, plain = p[first[k] : first[k] + size[k]], allowed[k] / allowed[k].sum()
        for _ in range(6):
            total = np.zeros(4)
            for w in own:
                total += w * plain / (w * plain).sum()
            plain = total / size[k]
        assert np.allclose(share[k], plain) and np.isclose(fit[k], sum(np.log((w * plain).sum()) for w in own))
    free, fit = language.mixture(p, first, size, np.ones((3, 4)), rounds=2)
    best = language.mixture(p, first, size, np.ones((3, 4)), rounds=5000)[1]
    assert (best <= fit + language.headroom(p, first, size, free) + 1e-9).all()


def test_set_is_the_best_by_penalised_likelihood():
    """Languages join by share while each gains more than the price: worked out row by row."""
    r = np.random.default_rng(3)
    m = language.Model(list("abcd"), np.log(r.dirichlet(np.full(language.BUCKETS, 0.5), 4).T).astype(np.float32))
    texts = [" ".join("".join(chr(97 + c) for c in r.integers(0, 26, 5)) for _ in range(n)) for n in (3, 30, 200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    shares, _ = language.infer(m, data, at)
    word, of_row = language.word_likelihoods(m, data, at)
    for k in range(3):
        own = word[of_row[k] : of_row[k + 1]]
        p, n = np.exp(own - own.max(axis=1, keepdims=True)), len(own)
        fit = lambda allowed: tuple(x[0] for x in language.mixture(p, np.array([0]), np.array([n]), np.array([allowed], float)))  # noqa: E731, B023
        order = np.argsort(-fit(np.ones(4))[0], kind="stable")
        single = np.log(p).sum(axis=0)
        best, gained = np.eye(4)[single.argmax()], single.max()
        for many in range(2, 5):
            got, likely = fit(np.isin(np.arange(4), order[:many]))
            if likely - gained <= language.PENALTY * np.log(n + 1):
                break
            best, gained = got, likely
        assert np.allclose(shares[k], best)


def test_null_ids_repeated_rows_and_clashing_names(spark):
    m = model(spark)
    df = spark.createDataFrame([(None, EN, 1, 2), (None, EN, 1, 2), (7, FR, 3, 4)], "doc_id long, text string, _text int, _letters int")
    got = language.identify(df, m, "doc_id", "_text", "_letters").collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r._text, r._letters) for r in got) == [(0, "en", 1, 2), (0, "en", 1, 2), (7, "fr", 3, 4)]
