import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import decontaminate
from siltstone.llm.text import PUNCTUATION, words


def weighed(w, n):
    out = Counter()
    for k in range(len(w) - n + 1):
        out[tuple(w[k : k + n])] += len(set(w[k : k + n]))
    return out


def brute(docs, items):
    """Every window of an item's size, by the weighted shingles alone."""
    tokens = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for item, text in items:
        w = tokens(text)
        if not w:
            continue
        n = min(5, len(w))
        b = weighed(w, n)
        for doc, t in docs:
            d = tokens(t)
            size = min(len(w), len(d))
            if size < n:
                continue
            best = 0
            for k in range(len(d) - size + 1):
                a = weighed(d[k : k + size], n)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[doc, item] = best
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + str(r.randrange(30))
    items = [(k, " ".join(word() for _ in range(r.choice([6, 12, 30, 45])))) for k in range(25)] + [(90, None), (91, ""), (92, "only three words"), (93, "... !"), (0, "same id but other words here now")]
    docs = []
    for k in range(150):
        w = [word() for _ in range(r.randrange(120))]
        if k % 2:
            passage = items[r.randrange(25)][1].upper().split(" ")
            for _ in range(r.randrange(3)):
                passage[r.randrange(len(passage))] = word()
            if k % 3 == 0:
                passage.insert(r.randrange(len(passage)), word())
            if k % 5 == 0:
                passage = passage[: -r.randrange(1, 4)]
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        docs.append((k, ", ".join(w)))
    docs += [(500, None), (501, ""), (502, items[3][1]), (503, "Only three\nwords"), (504, "x " * 50_000 + items[4][1]), (505, "the " * 50)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contamination(d, i).collect()}
    assert len(want) > 15 and got == pytest.approx(want)
    kept = {x.doc_id for x in decontaminate.clean(d, i).collect()}
    assert kept == {x for x, _ in docs} - {x for x, _ in want}
    assert decontaminate.contamination(d, i.limit(0)).count() == 0 and decontaminate.clean(d.limit(0), i).count() == 0


def test_blocks_hold_all_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    sf = "/root/testdata/sf0.001"
    by = sorted(map(tuple, decontaminate.query(spark, sf).collect()))
    monkeypatch.undo()
    assert by == sorted(map(tuple, decontaminate.query(spark, sf).collect())) and by


def test_lookup_without_the_shingle_bounds():
    """Every window against every item by fingerprints alone: nothing that brute force finds is missed, and little is checked."""
    r = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in range(60)]
    items = [(k, " ".join(r.choice(vocabulary, 40))) for k in range(60)]
    index = decontaminate.Index(items)
    found = wanted = checked = 0
    for k in range(60):
        passage = items[k][1].split()
        for at in r.integers(0, 40, k % 3):
            passage[at] = str(r.choice(vocabulary))
        text = " ".join([*r.choice(vocabulary, 80), *passage, *r.choice(vocabulary, 70)])
        w = next(words(pa.array([text]), PUNCTUATION))
        g, weight = decontaminate.shingles(w.hash, 5)
        first = np.arange(len(w.hash) - 40 + 1)
        got = index.search(g, weight, first, 36, np.arange(60))
        want = {i for _, i in brute([(0, text)], items)}
        found, wanted = found + len(want & set(got)), wanted + len(want)
        assert set(got) <= want
        prints = decontaminate.simhash(g, weight, first, 36)
        checked += sum(len(rows) for _, rows in index.candidates(prints, np.arange(60)))
    assert found == wanted > 20
    assert checked < 0.1 * 60 * 60 * len(first)


def test_memory_on_very_long_texts():
    """Items far apart, and one repeated, in texts of 4 MB."""
    item = " ".join(f"word{k}" for k in range(40))
    index = decontaminate.Index([(1, item), (2, item + " more")])
    far = item + " filler" * 600_000 + " " + item + " more"
    for text, want in ((far, {1, 2}), ((item + " ") * 14_000, {1, 2})):
        tracemalloc.start()
        began = time.process_time()
        found = {i: s for w in words(pa.array([text]), PUNCTUATION) for _, i, s, *_ in index.matches(w)}
        assert tracemalloc.get_traced_memory()[1] < 60 * len(text) and time.process_time() - began < 60
        tracemalloc.stop()
        assert set(found) == want and found[1] == 1


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(None, text, "x"), (None, text, "x"), (3, text, "x"), (3, "else", "x"), (4, None, None)], "doc_id long, text string, similarity string")
    items = spark.createDataFrame([(None, text), (8, text)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.similarity) for r in decontaminate.contamination(docs, items).collect())
    assert got == sorted((d, i, 1.0) for d in (0, 0, 3) for i in (0, 8))
    assert sorted((r.doc_id, r.text) for r in decontaminate.clean(docs, items).collect()) == [(3, "else"), (4, None)]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == 5
