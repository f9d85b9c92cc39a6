"""Quality rules: exact statistics of whole documents, hard limits, and boosted trees over the statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .boosting import Trees, fit
from .common import SPACES, blocks, encoded, labelled_sample, table

WINDOW = 8
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "not_ascii", "distinct", "longest", "line_words", "bars", "shouts", "short_lines", "top_word", "entropy", "quotes")
#: More repetition, shouting or symbols never makes a document better.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "shouts": -1, "bars": -1}
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more, the first of them included.

    Ranks of runs of 1, 2, 4 and 8 words by doubling: equal ranks are equal runs, exactly.
    """
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    width, top = 1, len(ids)
    while width < window:
        step = min(width, window - width)
        _, rank, count = np.unique(rank[:-step] * top + rank[step:], return_inverse=True, return_counts=True)
        top, width = len(count), width + step
        if top == len(rank):
            return 0
    hit = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(count[rank] > 1)
    hit[starts] += 1
    hit[starts + window] -= 1  # starts + window <= n
    return int((np.cumsum(hit) > 0).sum())


def statistics(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The five counts of the contract, and the features of the trees."""
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    spaces = int(bytes_[list(SPACES)].sum())
    points = len(text) - int(bytes_[0x80:0xC0].sum())
    symbols = int(bytes_[list(b"#*$%&|<>")].sum())
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    again = repeated(words)
    upper, lower, digits = (int(bytes_[a:b].sum()) for a, b in ((65, 91), (97, 123), (48, 58)))
    ascii_ = int(bytes_[33:127].sum())
    some, all_ = max(n, 1), max(points, 1)
    counts = np.array(list(Counter(words).values())) if n else np.zeros(1, np.int64)
    share = bytes_[bytes_ > 0] / max(len(text), 1)
    features = [
        np.log1p(n), (points - spaces) / some, symbols / some, dup / max(len(lines), 1), again / some, upper / max(upper + lower, 1), digits / all_,
        (ascii_ - upper - lower - digits) / all_, int(bytes_[128:].sum()) / max(len(text), 1), len(counts) / some, np.log1p(max(map(len, words), default=0)), n / max(len(lines), 1),
        int(bytes_[124]) / some, int(bytes_[33]) / some, sum(len(x) < 40 for x in lines) / max(len(lines), 1), int(counts.max()) / some, float(-(share * np.log2(share)).sum()), int(bytes_[[34, 39, 61]].sum()) / some,
    ]
    return (n, points - spaces, symbols, dup, again), features


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t)[1] for t in encoded(batch)]
        yield pa.RecordBatch.from_arrays([batch["y"].cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["y", "x"])


def fitted(docs: DataFrame, labels: DataFrame, rows: int = 6000, most_bytes: int = 1 << 20) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents of at most ``most_bytes`` bytes; without labels of both kinds they keep all."""
    sample = labelled_sample(docs, labels, "quality", rows, most_bytes)
    got = sorted((list(r.x), r.y) for r in sample.select("text", "y").mapInArrow(_features, "y int, x array<double>").collect())
    x, y = np.array([r[0] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], float)
    trees = fit(x, y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))
    if not len(trees.roots):
        trees.base = 5.0
    return trees


def _rules(trees: Trees, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                counts, features = zip(*map(statistics, encoded(block)), strict=True)
                c = np.array(counts, np.int64)
                failed = (c[:, 0] < 20) | (100 * c[:, 4] > 30 * c[:, 0])
                score = trees.probability(np.array(features))
                arrays = [block["doc_id"], *(pa.array(c[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, trees: Trees | None = None) -> DataFrame:
    """One row per document: its counts, base_failed, kept and the trees' score.

    A null or empty text has no words, so it fails.  Rows that repeat a doc_id are judged each on its
    own text.  An empty table gives no rows.  Other columns are ignored.
    """
    trees = trees or fitted(docs, labels)
    return docs.select("doc_id", "text").mapInArrow(_rules(trees, threshold), STATS + ", base_failed boolean, kept boolean, score double")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
