"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Node arrays of all trees one after the other; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def logit(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: int = 5) -> Trees:
    """monotone: per feature 1 (never falling), -1 (never rising) or 0.

    A split of a constrained feature must have its sides' values in order, and both sides are held
    on their side of the values' mean from there on down.
    """
    mean = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        logit = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-logit))
            grad, hess = y - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
            work = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
            while work:
                node, rows, low, high, level = work.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                nodes[node][4] = rate * float(np.clip(g / (h + l2), low, high))
                best = (1e-6, -1, -1, 0.0, 0.0)
                if level < depth and len(rows) >= 2 * least:
                    for f in range(x.shape[1]):
                        b = binned[rows, f]
                        gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(cuts[f]) + 1))[:-1] for w in (grad[rows], hess[rows], None))
                        if not len(gs):
                            continue
                        wl, wr = np.clip(gs / (hs + l2), low, high), np.clip((g - gs) / (h - hs + l2), low, high)
                        gain = gs * wl - (hs + l2) * wl**2 / 2 + (g - gs) * wr - (h - hs + l2) * wr**2 / 2
                        gain[(ns < least) | (len(rows) - ns < least) | (monotone[f] * (wr - wl) < 0)] = -np.inf
                        k = int(np.argmax(gain))
                        own = np.clip(g / (h + l2), low, high)
                        if (won := gain[k] - g * own + (h + l2) * own**2 / 2) > best[0]:
                            best = (won, f, k, wl[k], wr[k])
                if best[1] >= 0:
                    _, f, k, wl, wr = best
                    mid = (wl + wr) / 2
                    bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(int(monotone[f]), ((low, high), (low, high)))
                    goes = binned[rows, f] <= k
                    nodes[node][:4] = [f, float(cuts[f][k]), len(nodes), len(nodes) + 1]
                    for side, (lo, hi) in zip((rows[goes], rows[~goes]), bounds, strict=True):
                        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
                        work.append((len(nodes) - 1, side, lo, hi, level + 1))
                else:
                    logit[rows] += nodes[node][4]
    flat = np.array(nodes, float).reshape(-1, 5).T
    whole = lambda c: c.astype(np.int32)
    return Trees(base, np.array(roots, np.int32), whole(flat[0]), flat[1], whole(flat[2]), whole(flat[3]), flat[4], depth)
