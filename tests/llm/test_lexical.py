"""Bit-sliced search against plain scoring, and its carry arithmetic against integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lintlake.llm import lexical

from .cases import docs, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k=20):
    """(item, rank, doc_id, score) by a loop over all documents."""
    of = [(i, Counter(terms(t))) for i, t in rows]
    n = [sum(c.values()) for _, c in of]
    documents, words, df = sum(x > 0 for x in n), sum(n), Counter(t for _, c in of for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc_id, c), length in zip(of, n, strict=True):
            m = 75 + 25 * length * documents // max(words, 1)
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1) if s[0]]
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_slices_add_and_multiply_as_numbers_do():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 20, (2, 3, 130))
    cut = lambda x, bits: np.stack([lexical.words_of((x >> i & 1).astype(np.uint8)) for i in range(bits)])
    sums = cut(a, 24)
    lexical.add(sums, cut(b, 20))
    assert np.array_equal(sums, cut(a + b, 24))
    w = np.array([0, 1, 12345])
    assert np.array_equal(lexical.times(cut(a, 20), w, 36), cut(a * w[:, None], 36))
    row, place = np.divmod(np.arange(3 * 130), 130)
    assert np.array_equal(lexical.laid_out(a.reshape(-1), row, place, (20, 3, 3)), cut(a, 20))


@pytest.mark.parametrize("k", [1, 3, 20, 500])
def test_highest_as_by_sorting(k):
    rng = np.random.default_rng(k)
    for top in (1, 2, 5, 1 << 30):
        values = rng.integers(0, top, (4, 200))
        sums = np.stack([lexical.words_of((values >> i & 1).astype(np.uint8)) for i in range(31)])
        for v, (place, score) in zip(values, lexical.highest(sums, 200, k), strict=True):
            want = sorted((-x, i) for i, x in enumerate(v.tolist()) if x)[:k]
            assert sorted(zip((-score).tolist(), place.tolist(), strict=True)) == want


def test_awkward_documents_and_items(spark):
    rows = [(i, t) for i, t, _ in texts()]
    items = [(1, "alpha3 BETA3 gamma gamma gamma"), (2, None), (3, ""), (4, "nothing_here"), (5, "same"), (6, "é 汉字 ünd A"), (7, "one a a"), (None, "tail x" + "x" * 299), (8, "gamma " * 1000 + rows[0][1]), (9, "w1 w2")]
    items = [*items, (1, "tail")]  # two rows of one item are one query
    want = [(1, "alpha3 BETA3 gamma gamma gamma tail"), *items[1:-1]]
    for frame in (docs(spark).coalesce(1), docs(spark)):
        assert got(lexical.search(lexical.build(frame), table(spark, items), 4)) == plain(rows, want, 4)


def test_many_blocks_batches_and_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 70)
    monkeypatch.setattr(lexical, "BATCH", 40)
    monkeypatch.setattr(lexical, "TOGETHER", 3)
    rng = random.Random(2)
    word = lambda: f"t{int(rng.paretovariate(0.7)) % 300}"
    rows = [(i % 380, " ".join(word() for _ in range(rng.randrange(30)))) for i in range(400)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(12)))) for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = lexical.build(frame)
    assert got(lexical.search(index, table(spark, items))) == plain(rows, items)
    assert lexical.load(index.rows).documents == index.documents == sum(bool(t) for _, t in rows)
    assert index.rows.where("slices IS NOT NULL").count() and index.rows.where("places IS NOT NULL").count()
    asked = lexical.search(index, table(spark, items))
    assert "CartesianProduct" not in asked._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in asked._jdf.queryExecution().toString()


def test_empty_tables(spark):
    none = docs(spark, [])
    assert got(lexical.search(lexical.build(none), table(spark, [(1, "a")]))) == []
    assert got(lexical.search(lexical.build(docs(spark)), table(spark, []))) == []
    assert got(lexical.search(lexical.build(docs(spark, [(1, None, None), (2, " . ", None)])), table(spark, [(1, "a")]))) == []
