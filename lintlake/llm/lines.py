"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its features are statistics of the line and of the lines before and after
it; the chain's weights say how likely neighbours agree.  Forward-backward gives each line's marginal,
and a document's quality is the mean of its lines' marginals, weighted by their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, best_cut, blocks, collected, encoded, held_out, label_share, labelled_sample, sigmoid, stable_hash, table

#: Character classes whose share of a line's characters is a feature.
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "shout": b"!", "bar": b"|", "stop": b".,;", "symbol": b"#*$%&<>@^~_=+{}[]\\", "quote": b"\"'`", "high": range(128, 256), "space": SPACES}
WINDOW, OTHERS = 8, 9


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word (one empty line for a text without any), their lengths, and lines per text."""
    lines, per, seen_flags, again, twice = [], [], [], [], []
    for text in texts:
        own = [x for x in text.split(b"\n") if x.strip(SPACES)] or [b" "]
        seen: set[bytes] = set()
        for x in own:
            seen_flags.append(x in seen)
            seen.add(x)
        words = [x.split() for x in own]
        again.append(_again(words))
        twice += [sum(map(bytes.__eq__, w[1:], w)) / max(len(w), 1) for w in words]
        lines += own
        per.append(len(own))
    length = np.array([len(x) for x in lines], np.int64)
    at = np.cumsum(length) - length
    raw = np.frombuffer(b"".join(lines), np.uint8)
    shares = []
    for members in CLASSES.values():
        is_in = np.zeros(256, np.int32)
        is_in[list(members)] = 1
        shares.append(np.add.reduceat(is_in[raw], at) / length)
    n_words = np.array([max(len(x.split()), 1) for x in lines], float)
    others = [np.log1p(length) / 8, np.log1p(n_words) / 6, length / n_words / 20, np.array(seen_flags, float), np.concatenate(again), np.array(twice)]
    named = dict(zip(CLASSES, shares, strict=True))
    others += [np.minimum(20 * named[c], 1) for c in ("bar", "shout")] + [(named["upper"] > named["lower"]).astype(float)]
    return np.stack([*shares, *others], axis=1), length, np.array(per)


def _again(lines: list[list[bytes]]) -> np.ndarray:
    """Per line the share of its words in runs of 8 words that the text holds elsewhere too, by hashes of the runs."""
    size = np.array([len(x) for x in lines], np.int64)
    n = int(size.sum())
    if n <= WINDOW:
        return np.zeros(len(lines))
    h = stable_hash([w for x in lines for w in x])
    run = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[i : n - WINDOW + 1 + i]
    order = np.argsort(run)
    same = np.zeros(len(run), bool)
    equal = run[order][1:] == run[order][:-1]
    same[order[1:][equal]] = same[order[:-1][equal]] = True
    step = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(same)
    step[starts] += 1
    step[starts + WINDOW] -= 1
    hit = (np.cumsum(step[:-1]) > 0).astype(np.int64)
    end = np.cumsum(size)
    upto = np.concatenate([[0], np.cumsum(hit)])
    return (upto[end] - upto[end - size]) / np.maximum(size, 1)


def with_neighbours(x: np.ndarray, per: np.ndarray) -> np.ndarray:
    """A line's own features, those of the lines before and after it in its text (0 beyond its ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    end = np.cumsum(per)
    before[end - per], after[end - 1] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


class Field:
    """Two labels.  weight: of label 1 against 0 by feature; pair[a, b]: of a line labelled a before one labelled b."""

    def __init__(self, features: int):
        self.weight, self.pair, self.slope, self.shift = np.zeros(features), np.zeros((2, 2)), 1.0, 0.0

    def marginals(self, x: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label 1) of each line, and the expected count of each pair of neighbouring labels."""
        order = np.argsort(-per, kind="stable")
        size, begin = per[order], (np.cumsum(per) - per)[order]
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(steps), side="left")
        unary = np.stack([np.zeros(len(x)), x @ self.weight], axis=1)
        forth, back = unary.copy(), np.zeros_like(unary)
        for t in range(1, steps):
            i = begin[: live[t]] + t
            forth[i] += np.logaddexp(forth[i - 1, :1] + self.pair[0], forth[i - 1, 1:] + self.pair[1])
            forth[i] -= forth[i].max(axis=1, keepdims=True)  # only differences within a line count
        for t in range(steps - 2, -1, -1):
            i = begin[: live[t + 1]] + t
            ahead = back[i + 1] + unary[i + 1]
            back[i] = np.logaddexp(ahead[:, :1] + self.pair[:, 0], ahead[:, 1:] + self.pair[:, 1])
            back[i] -= back[i].max(axis=1, keepdims=True)
        both = forth + back
        p = sigmoid(both[:, 1] - both[:, 0])
        inner = np.ones(len(x), bool)
        inner[begin] = False
        i = np.flatnonzero(inner)
        joint = forth[i - 1, :, None] + self.pair + (back[i] + unary[i])[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return p, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def quality(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean marginal of each text, as a logit."""
        x, length, per = line_features(texts)
        p, _ = self.marginals(with_neighbours(x, per), per)
        first = np.cumsum(per) - per
        mean = np.add.reduceat(p * length, first) / np.add.reduceat(length, first)
        mean = np.clip(mean, 1e-9, 1 - 1e-9)
        return np.log(mean / (1 - mean))


def train(sample: list[tuple[bytes, int]], share: float = 0.5, steps: int = 200, rate: float = 0.05, l2: float = 1e-3) -> Field:
    """Adam on the chain's likelihood; a labelled document's lines all carry its label.  One document in five sets the cut."""
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], float)
    width = 3 * (len(CLASSES) + OTHERS) + 1
    field = Field(width)
    if not len(y) or not 0 < y.sum() < len(y):
        return field
    aside = np.array([zlib.crc32(t) % 5 == 0 for t in texts], bool)
    fit = np.flatnonzero(~aside)
    x, _, per = line_features([texts[i] for i in fit])
    x = with_neighbours(x, per)
    label = np.repeat(y[fit], per)
    each = np.repeat(1 / per, per)  # a document weighs the same whatever its number of lines
    inner = np.ones(len(x), bool)
    inner[np.cumsum(per) - per] = False
    seen = np.array([[np.sum(label[inner] == 0), 0], [0, np.sum(label[inner] == 1)]], float)
    theta, m, s = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, steps + 1):
        field.weight, field.pair = theta[:width], theta[width:].reshape(2, 2)
        p, pairs = field.marginals(x, per)
        grad = np.concatenate([x.T @ ((p - label) * each) / len(fit), (pairs - seen).ravel() / len(x)]) + l2 * theta
        m += 0.1 * (grad - m)
        s += 0.01 * (grad**2 - s)
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    rest = np.flatnonzero(aside) if min(y[aside].sum(), (1 - y[aside]).sum()) >= 20 else np.arange(len(y))
    # Bad documents are the rarer kind: the cut is the best one for finding them.
    field.shift = -best_cut(-field.quality([texts[i] for i in rest]), 1 - y[rest], 1 - share)
    return field


def fitted(docs: DataFrame, labels: DataFrame, rows: int = 4000, most_bytes: int = 65_536) -> Field:
    """Trained on at most ``rows`` labelled documents of at most ``most_bytes`` bytes, none of them held out (crc32 of doc_id mod 5 = 0)."""
    return train(collected(labelled_sample(docs, labels, "quality", rows, most_bytes, (5, 0))), label_share(labels, "quality", (5, 0)))


def _score(field: Field, threshold: float):
    at = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1 << 19):
                score = sigmoid(field.quality(encoded(block)) - field.shift + at)
                yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(score)], ["doc_id", "score"])

    return run


def line_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    All lines of whole texts count; a null, empty or blank text is one empty line.  Rows that repeat
    a doc_id are scored each.  An empty table gives no rows; without labels of both kinds all
    lines are even.  Other columns are ignored.
    """
    field = field or fitted(docs, labels)
    scored = docs.select("doc_id", "text").mapInArrow(_score(field, threshold), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
