"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its embedding (frequent words of the training sample) beside the mean embedding of
its character trigrams.  The network reads windows of 16 words that overlap by half (one starts at every
8th word, and the last one ends with the text); a document's logit is the log-sum-exp over all of its
windows less half the logarithm of their number, so that one bad passage in a long text counts and length
alone does not.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import best_cut, blocks, collected, encoded, held_out, label_share, labelled_sample, sigmoid, table

WINDOW, STRIDE = 16, 8
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS = 8, 8, 8, 4096
#: How much of the logarithm of the number of windows comes off a document's logit.
LENGTH_WEIGHT = 0.5
EDGES = bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def window_starts(n: int, stride: int = STRIDE) -> list[int]:
    """All windows of a text of n words; the last ends with the text, a shorter text is one window."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, stride), n - WINDOW]


def inputs(words: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: vocabulary rows (0: not in it), trigram rows one after the other, and how many each word has."""
    bare = [w.strip(EDGES) or w or b" " for w in words]
    rows = np.array([vocabulary.get(w, 0) for w in bare], np.int64)
    joined = np.frombuffer(b"".join(b"^" + w + b"$" for w in bare), np.uint8).astype(np.int64)
    count = np.array([len(w) for w in bare], np.int64)  # trigrams of ^w$
    ends = np.cumsum(count + 2)
    tri = (joined[:-2] * 961 + joined[1:-1] * 31 + joined[2:]) * 40503 >> 5 & CHAR_ROWS - 1
    inner = np.ones(len(joined), bool)
    inner[ends - 1] = inner[ends - 2] = False
    return rows, tri[inner[:-2]], count


class Lexicon:
    """The distinct words of some texts (number 0: the empty word) with their inputs, and the texts as numbers of words."""

    def __init__(self, texts: list[list[bytes]], vocabulary: dict[bytes, int], least: int = 1):
        ids: dict[bytes, int] = {b"": 0}
        self.texts = [np.array([ids.setdefault(w, len(ids)) for w in t] + [0] * (least - len(t)), np.int64) for t in texts]
        self.rows, self.tri, self.count = inputs(list(ids), vocabulary)
        self.begin = np.cumsum(self.count) - self.count

    def inputs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = self.count[words]
        at = np.arange(int(count.sum())) + np.repeat(self.begin[words] - np.cumsum(count) + count, count)
        return self.rows[words], self.tri[at], count


def windows(sizes: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Of texts one after the other: where their windows start, and how many each has."""
    begin, starts = np.cumsum(sizes) - sizes, [window_starts(n, stride) for n in sizes.tolist()]
    return np.concatenate([b + np.array(s) for b, s in zip(begin, starts, strict=True)]), np.array([len(s) for s in starts])


def pooled(z: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A logit for each document from those of its windows, and each window's share in it."""
    first, doc = np.cumsum(per) - per, np.repeat(np.arange(len(per)), per)
    top = np.maximum.reduceat(z, first)
    share = np.exp(z - top[doc])
    total = np.add.reduceat(share, first)
    return top + np.log(total) - LENGTH_WEIGHT * np.log(per), share / total[doc]


class Network:
    def __init__(self, vocabulary: dict[bytes, int], seed: int = 3):
        rng = np.random.default_rng(seed)
        make = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        h = HIDDEN
        self.vocabulary, self.shift = vocabulary, 0.0
        self.p = {
            "word": make(len(vocabulary) + 1, WORD_DIM, s=0.3), "char": make(CHAR_ROWS, CHAR_DIM, s=0.5), "wx": make(WORD_DIM + CHAR_DIM, 6 * h, s=0.3), "b": np.zeros(6 * h, np.float32),
            "uf": make(h, 3 * h, s=0.3), "ub": make(h, 3 * h, s=0.3), "v": make(2 * h, s=0.5), "w": make(2 * h, s=0.5), "c": np.full(1, -4, np.float32),
        }
        self.p["word"][0] = 0

    def gates(self, rows: np.ndarray, tri: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What distinct words add to the gates of both directions, once for all windows they are in; and their inputs."""
        chars = np.add.reduceat(self.p["char"][tri], np.cumsum(count) - count, axis=0) / count[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][rows], chars], axis=1)
        return x @ self.p["wx"] + self.p["b"], x

    def run(self, g: np.ndarray, ids: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """g: gate inputs by row, ids: (windows, steps) rows.  Attention weights, outputs (both steps x windows) and window logits."""
        n, steps, h = len(ids), ids.shape[1], HIDDEN
        score, out = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
        for d, u in enumerate((self.p["uf"], self.p["ub"])):
            own, read = g[:, 3 * h * d : 3 * h * (d + 1)], np.stack([self.p["v"][h * d : h * (d + 1)], self.p["w"][h * d : h * (d + 1)]], axis=1)
            state = np.zeros((n, h), np.float32)
            for t in range(steps)[:: 1 - 2 * d]:
                x, a = own[ids[:, t]], state @ u
                zr = np.tanh((x[:, : 2 * h] + a[:, : 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
                if keep is not None:
                    keep.append((d, t, state, z, r, new, a[:, 2 * h :]))
                state = new + z * (state - new)
                both = state @ read
                score[t] += both[:, 0]
                out[t] += both[:, 1]
                if keep is not None:
                    keep[-1] += (state,)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        return weight, out, (weight * out).sum(axis=0) + self.p["c"][0]

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """A logit for each document, from all of its windows."""
        lexicon = Lexicon(texts, self.vocabulary)
        g = self.gates(lexicon.rows, lexicon.tri, lexicon.count)[0][np.concatenate(lexicon.texts)]
        size = np.array([len(t) for t in lexicon.texts])
        starts, per = windows(size)
        length = np.repeat(np.minimum(size, WINDOW), per)
        z = np.empty(len(starts), np.float32)
        for steps in np.unique(length):
            of = np.flatnonzero(length == steps)
            for part in np.array_split(of, max(1, len(of) // 4096)):
                z[part] = self.run(g, starts[part][:, None] + np.arange(steps))[2]
        return pooled(z, per)[0]

    def gradient(self, lexicon: Lexicon, some: list[int], y: np.ndarray, stride: int = STRIDE, least: float = 0.0) -> dict[str, np.ndarray]:
        """Of the mean log loss over some of the lexicon's documents, each of WINDOW words at least; windows in which the loss is flatter than ``least`` are left out."""
        p, h = self.p, HIDDEN
        texts = [lexicon.texts[i] for i in some]
        starts, per = windows(np.array([len(t) for t in texts]), stride)
        doc = np.repeat(np.arange(len(texts)), per)
        used, at = np.unique(np.concatenate(texts)[starts[:, None] + np.arange(WINDOW)], return_inverse=True)
        at = at.reshape(-1, WINDOW)
        logit, share = pooled(self.run(self.gates(*lexicon.inputs(used))[0], at)[2], per)
        dz = ((sigmoid(logit) - y) / len(y))[doc] * share
        steep = np.abs(dz) >= least
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        if not steep.any():
            return grad
        dz, (left, at) = dz[steep], np.unique(at[steep], return_inverse=True)
        at = at.reshape(-1, WINDOW)
        rows, tri, count = lexicon.inputs(used[left])
        g, x = self.gates(rows, tri, count)
        keep: list = []
        weight, out, _ = self.run(g, at, keep)
        dweight = dz * out
        dscore, dout = weight * (dweight - (weight * dweight).sum(axis=0)), dz * weight
        grad["c"][0] = dz.sum()
        dg = np.zeros((WINDOW, len(at), 6 * h), np.float32)
        carry = [np.zeros((len(at), h), np.float32)] * 2
        for d, t, before, zg, r, new, a, state in reversed(keep):
            v, w, u = p["v"][h * d : h * (d + 1)], p["w"][h * d : h * (d + 1)], p["ub" if d else "uf"]
            grad["v"][h * d : h * (d + 1)] += dscore[t] @ state
            grad["w"][h * d : h * (d + 1)] += dout[t] @ state
            dh = dscore[t][:, None] * v + dout[t][:, None] * w + carry[d]
            dn = dh * (1 - zg) * (1 - new**2)
            dzg, dr = dh * (before - new) * zg * (1 - zg), dn * a * r * (1 - r)
            da = np.concatenate([dzg, dr, dn * r], axis=1)
            dg[t, :, 3 * h * d : 3 * h * (d + 1)] = np.concatenate([dzg, dr, dn], axis=1)
            grad["ub" if d else "uf"] += before.T @ da
            carry[d] = dh * zg + da @ u.T
        flat = at.T.ravel()
        order = np.argsort(flat, kind="stable")
        sums = np.add.reduceat(dg.reshape(-1, 6 * h)[order], np.searchsorted(flat[order], np.arange(len(left))), axis=0)
        grad["wx"], grad["b"] = x.T @ sums, sums.sum(axis=0)
        dx = sums @ p["wx"].T
        for k in range(WORD_DIM):
            grad["word"][:, k] = np.bincount(rows, weights=dx[:, k], minlength=len(p["word"]))
        grad["word"][0] = 0
        each = np.repeat(dx[:, WORD_DIM:] / count[:, None], count, axis=0)
        for k in range(CHAR_DIM):
            grad["char"][:, k] = np.bincount(tri, weights=each[:, k], minlength=CHAR_ROWS)
        return grad


def train(sample: list[tuple[bytes, int]], share: float = 0.5, epochs: int = 5, batch: int = 16, rate: float = 0.02, least_steps: int = 400, vocabulary: int = 20_000, seed: int = 3) -> Network:
    """Adam over the sample, ``epochs`` times or for ``least_steps`` steps; one document in six is left out and sets the place of the cut."""
    texts, y = [words_of(t) for t, _ in sample], np.array([v for _, v in sample], np.float32)
    seen = Counter(w.strip(EDGES) or w for t in texts for w in set(t))
    frequent = sorted((w for w, n in seen.items() if n >= 5), key=lambda w: (-seen[w], w))[:vocabulary]
    net = Network({w: i for i, w in enumerate(frequent, 1)}, seed)
    aside = np.array([zlib.crc32(t) % 6 == 0 for t, _ in sample], bool)
    fit = np.flatnonzero(~aside)
    lexicon = Lexicon([texts[i] for i in fit], net.vocabulary, WINDOW)
    rng = np.random.default_rng(seed)
    m, s = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    epochs = max(epochs, -(-least_steps // max(1, len(fit) // batch)))
    if len(fit) and 0 < y[fit].sum() < len(fit):
        for epoch in range(epochs):
            order = rng.permutation(len(fit))
            for part in np.array_split(order, max(1, len(order) // batch)):
                step += 1
                grad = net.gradient(lexicon, part, y[fit[part]], WINDOW, 1e-3 / len(part))
                for k, value in net.p.items():
                    m[k] += 0.1 * (grad[k] - m[k])
                    s[k] += 0.01 * (grad[k] ** 2 - s[k])
                    value -= rate * 0.08 ** (epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    rest = np.flatnonzero(aside) if min(y[aside].sum(), (1 - y[aside]).sum()) >= 20 else np.arange(len(y))
    if len(rest):
        net.shift = best_cut(net.logits([texts[i] for i in rest]), y[rest], share, 0.03)
    return net


def _score(net: Network, threshold: float):
    at = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1 << 19):
                score = sigmoid(net.logits([words_of(t) for t in encoded(block)]).astype(float) - net.shift + at)
                yield pa.RecordBatch.from_arrays([*(block[c] for c in block.schema.names if c != "text"), pa.array(score)], [*(c for c in block.schema.names if c != "text"), "score"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, rows: int = 3200, most_bytes: int = 16_384) -> Network:
    """Trained on at most ``rows`` labelled documents of at most ``most_bytes`` bytes, none of them held out (crc32 of doc_id mod 3 = 1)."""
    return train(collected(labelled_sample(docs, labels, "toxic", rows, most_bytes, (3, 1))), label_share(labels, "toxic", (3, 1)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, net: Network | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Whole texts are scored, window by window.  Null and empty texts are one window of an empty word.
    Rows that repeat a doc_id are scored each.  An empty table gives no rows; without labels of both
    kinds the network stays untrained.  Other columns are ignored.
    """
    net = net or fitted(docs, labels)
    scored = docs.select("doc_id", "text").mapInArrow(_score(net, threshold), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with their columns; the text travels through the scoring, so no join is needed.

    Null and empty texts are scored as one empty word; rows that repeat are scored each; an empty table gives no
    rows; without labels of both kinds the network is untrained, its cut is where a logit is 0, and what it keeps says nothing.
    """
    net, columns = fitted(docs, labels), docs.columns
    kinds = dict(docs.dtypes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = float(np.log(threshold / (1 - threshold)))
        for batch in batches:
            for block in blocks(batch, 1 << 19):
                score = sigmoid(net.logits([words_of(t) for t in encoded(block)]).astype(float) - net.shift + at)
                yield block.filter(pa.array(score < threshold))

    return docs.mapInArrow(keep, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
