"""Word shingles of whole texts as 64-bit hashes, and their MinHash signatures, by the batch."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS, HASHES, BANDS = 2, 128, 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A-Z is lowered; a text with fewer words than a shingle has is one shingle of all its words; one
    without words has none.  A word counts by 64 bits of its digest, a shingle by a mix of its
    words in order.
    """
    ids: dict[bytes, int] = {}
    split = [t.lower().split() for t in texts]
    flat = np.fromiter((ids.setdefault(w, len(ids)) for t in split for w in t), np.int64)
    digest = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in ids), np.uint64)
    h = _mix(digest)[flat] if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    for t in split:
        n = min(words, len(t))
        own = h[at : at + len(t)]
        at += len(t)
        run = np.full(max(len(t) - n + 1, 0) if n else 0, n, np.uint64)
        for i in range(n):
            run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + own[i : i + len(run)])
        run.sort()
        out.append(run[np.diff(run, prepend=~run[:1]) != 0] if len(run) else run)
    return out


def universal(hashes: int = HASHES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier (odd) and addend of each universal hash: the top 32 bits of a * x + b mod 2**64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, hashes, dtype=np.uint64)


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """(texts, hashes) uint32 minima; all ones for an empty set."""
    out = np.full((len(sets), hashes), 0xFFFFFFFF, np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    a, b = universal(hashes)
    at = 0
    while at < len(some):  # about 16 thousand shingles at a time stay in the cache
        stop, size = at, 0
        while stop < len(some) and (not size or size + len(sets[some[stop]]) <= 1 << 14):
            size += len(sets[some[stop]])
            stop += 1
        x = np.concatenate([sets[i] for i in some[at:stop]])
        n = np.array([len(sets[i]) for i in some[at:stop]])
        first = np.cumsum(n) - n
        for k in range(hashes):
            out[some[at:stop], k] = np.minimum.reduceat(x * a[k] + b[k], first) >> np.uint64(32)
        at = stop
    return out
