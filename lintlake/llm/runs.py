"""Periodic runs of words, found from a harmonic grid.

For every period p the grid points are the multiples of p: n / p of them, so n log n pairs (p, point) for n words.  A run of
period p and at least four periods holds the first grid point i in it together with i + 3p, so the pair shows equal words p apart
and equal blocks there; pairs that do not are dropped by one comparison each.  For all pairs left the longest common extensions of i and i + p to the right
and to the left are found at once, by binary search over prefix hashes in numpy.  What they tell is then verified word by word,
and runs that several points or multiples of a period found are one.  A text is one task's work; no shuffle.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, encoded, table

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 6, 4
PRIME = (1 << 31) - 1
#: Pairs of a period and a grid point that are looked at together.
PAIRS = 1 << 19


def stuttered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query takes them: for one doc_id in ten (by its crc32) the tail repeats its first words."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


class PrefixHashes:
    """Hashes of all prefixes of a sequence modulo a prime, to a base drawn by ``seed``; equal words have equal hashes, others seldom."""

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        base, n = int(rng.integers(1 << 20, PRIME - 1)), len(ids)
        self.powers = np.ones(n + 1, np.int64)
        done = 1
        while done <= n:  # doubling: the second half of the powers is the first half times one power
            more = min(done, n + 1 - done)
            self.powers[done : done + more] = self.powers[:more] * pow(base, done, PRIME) % PRIME
            done += more
        letters = rng.integers(1, PRIME, int(ids.max()) + 1)
        self.prefix = np.concatenate([[0], np.cumsum(letters[ids] * self.powers[:-1] % PRIME) % PRIME])

    def same(self, at: np.ndarray, length: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``at`` hash like those ``apart`` further on."""
        p = self.prefix
        first = (p[at + length] - p[at]) % PRIME * self.powers[apart] % PRIME
        return first == (p[at + apart + length] - p[at + apart]) % PRIME

    def extension(self, at: np.ndarray, apart: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, ``most`` at most, from ``at`` on (or before it) equal those ``apart`` further on: one binary search for all pairs; never too few."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            holds = self.same(at - middle if back else at, middle, apart)
            low, high = np.where(holds, middle, low), np.where(holds, high, middle - 1)
        return low


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (period, grid point) with four periods of words from the point on, some PAIRS at a time."""
    periods = np.arange(1, n // TIMES + 1)
    # A first grid point i of a run lies less than p after its start, so i + 3p stands inside.
    points = np.maximum((n - 3 * periods - 1) // periods + 1, 0)
    ends, start = np.cumsum(points), 0
    while start < len(periods):
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")), start + 1)
        count = points[start:stop]
        p = np.repeat(periods[start:stop], count)
        yield p, (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p
        start = stop


def _claimed(ids: np.ndarray, hashes: PrefixHashes) -> np.ndarray:
    """(start, end, period) of every stretch of four periods that the hashes tell, sorted, each once."""
    n, found = len(ids), []
    for p, i in _grid(n):
        for k in (0, 1, 2):  # the words at the first three steps from the point
            near = ids[i + k * p] == ids[i + (k + 1) * p]
            p, i = p[near], i[near]
        near = hashes.same(i, 2 * p, p)
        p, i = p[near], i[near]
        if len(p):
            right = hashes.extension(i, p, n - p - i, False)
            left = hashes.extension(i, p, i, True)
            start, end = i - left, i + p + right
            long = end - start >= np.maximum(LEAST, TIMES * p)
            found.append(np.unique(np.stack([start, end, p], 1)[long], axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _verified(ids: np.ndarray, runs: np.ndarray) -> bool:
    """Whether each stretch really has its period in all its words and is extended by neither neighbour."""
    n = len(ids)
    for s, e, p in runs.tolist():
        if not np.array_equal(ids[s : e - p], ids[s + p : e]) or (s and ids[s - 1] == ids[s - 1 + p]) or (e < n and ids[e] == ids[e - p]):
            return False
    return True


def periodic_runs(ids: np.ndarray) -> np.ndarray:
    """(start, end, smallest period) of all runs of a sequence, by start and period: stretches of at least LEAST words and TIMES periods that no neighbour extends.

    Where hashes told more than the words hold, all is done again with another base, until the words verify everything.
    """
    if len(ids) < LEAST:
        return np.zeros((0, 3), np.int64)
    for seed in itertools.count():
        claims = _claimed(ids, PrefixHashes(ids, seed))
        first = np.ones(len(claims), bool)
        first[1:] = (claims[1:, :2] != claims[:-1, :2]).any(1)
        runs = claims[first]  # of the periods of one stretch the smallest; all others must be its multiples
        others = claims[:, 2] % runs[np.cumsum(first) - 1, 2] == 0
        if others.all() and _verified(ids, runs):
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def run_spans(docs: DataFrame, words_of=lambda words, doc_id: words) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period in words, by start and period), text: the words kept, joined by one space.

    Words are runs of anything but the six ASCII white-space characters, of the whole text.  ``words_of``: what to make of a
    document's words first.  Null and empty texts have no words and no runs; rows that repeat a doc_id, or have none, count each
    by itself; other columns of ``docs`` are left out, and an empty table gives no rows.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                ids, counts, listed, kept = block["doc_id"].to_pylist(), [], [], []
                for doc_id, text in zip(ids, encoded(block), strict=True):
                    words = words_of(text.split(), doc_id)
                    runs = periodic_runs(word_ids(words))
                    counts.append(len(words))
                    listed.append([{"start": s, "length": e - s, "period": p} for s, e, p in runs.tolist()])
                    stay = collapsed(len(words), runs)
                    kept.append(b" ".join(words if stay.all() else itertools.compress(words, stay.tolist())))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(counts, pa.int64()), pa.array(listed, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(spans, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of equal ones the first), and digests of all runs and of the words kept."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    each = found.select("doc_id", "runs", "text", longest.alias("m"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"))
    start, period = -F.col("m.before"), -F.col("m.shorter")
    return each.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), F.col("m.length").alias("length"), period.alias("period"), F.expr("1000 * m.length div -m.shorter").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


def op11_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(run_spans(table(spark, sf_dir, "documents"), stuttered))
