"""Periodic runs against a brute-force search, hand-made cases and texts that mislead hashes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lintlake.llm import runs

from .cases import docs, texts, words


def plain_runs(w):
    """Every stretch by its definition: per period the stretches that nothing extends, then those without a smaller period."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i:
                s, e = i, j + p
                if e - s >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                    out.append((s, e, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(((-(e - s), s, q) for s, e, q in found), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(found), *top, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def found(w):
    return [tuple(r) for r in runs.periodic_runs(runs.word_ids(list(w))).tolist()]


@pytest.mark.parametrize("w, want", [("", []), ("aaaaa", []), ("aaaaaa", [(0, 6, 1)]), ("abababa", []), ("abababab", [(0, 8, 2)]), ("xabababababy", [(1, 11, 2)]), ("aaaaaabbbbbb", [(0, 6, 1), (6, 12, 1)]), ("abcabcabcabcab", [(0, 14, 3)])])
def test_hand_made(w, want):
    assert found(w) == want


def test_random_sequences_against_brute_force():
    rng = random.Random(3)
    for _ in range(1000):
        letters, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.randrange(0, 90)
        w = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.6 and n:  # plant a repetition, then perhaps spoil a word
            p = rng.randrange(1, 1 + max(n // 4, 1))
            s = rng.randrange(n)
            e = min(n, s + p * rng.randrange(3, 8) + rng.randrange(p + 1))
            w[s:e] = [w[s + (i % p)] if s + (i % p) < n else 0 for i in range(e - s)]
            if rng.random() < 0.3:
                w[rng.randrange(n)] = 99
        assert found(w) == plain_runs(w)


def test_long_sequences():
    assert found([7] * 30_000) == [(0, 30_000, 1)]
    w = list(range(500)) + [i % 499 for i in range(2500)] + list(range(100))
    assert found(w) == plain_runs(w) != []


def test_thue_morse_and_fibonacci():
    """Words in which hashes to a power-of-two modulus collide, and words with very many runs."""
    t = [bin(i).count("1") & 1 for i in range(1 << 11)]
    assert found(t + t) == plain_runs(t + t) == []
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert found(b) == plain_runs(b)
    c = [x for x in b[:300] for _ in range(7)]
    assert found(c) == plain_runs(c)


def test_a_colliding_hash_is_found_out(monkeypatch):
    """With letters that all hash alike everything looks periodic; the words tell, and another seed is taken."""
    seen, real = [], runs.PrefixHashes

    class Bad(real):
        def __init__(self, ids, seed):
            super().__init__(ids if seed > 1 else np.zeros_like(ids), seed)
            seen.append(seed)

    monkeypatch.setattr(runs, "PrefixHashes", Bad)
    w = list(b"abcabcabcabcabcxabcabdabcabc") * 2
    assert found(w) == plain_runs(w) and seen == [0, 1, 2]


def test_documents_as_by_brute_force(spark):
    rng = random.Random(5)
    items = [(i, t, s) for i, t, s in texts()] + [(i, " ".join(rng.choice("ab cd e".split()) for _ in range(rng.randrange(60))), None) for i in range(100, 160)] + [(-5, "k l m n " * 50, "a"), (1000, "é é é " * 9, "a")]
    items = [x for x in items if x[0] != 7]
    rows = runs.digests(runs.run_spans(docs(spark, items), runs.stuttered)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in rows), key=key) == sorted((plain_digest(i, t) for i, t, _ in items), key=key)
    assert any(r.n_runs for r in rows) and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in items)


def test_general_interface_and_empty_table(spark):
    rows = {r.doc_id: r for r in runs.run_spans(docs(spark)).collect()}
    assert rows[15].runs[0].asDict() == {"start": 0, "length": 400, "period": 1} and rows[15].text == "same" and rows[15].n_words == 400
    assert rows[4].runs == [] and rows[4].text == "" and rows[5].n_words == 0
    assert runs.digests(runs.run_spans(docs(spark, []), runs.stuttered)).collect() == []
