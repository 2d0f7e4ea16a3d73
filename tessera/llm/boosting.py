"""Gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 60, 3, 0.25, 24, 2.0, 1.0


class BoostedTrees:
    """Trees as heaps of (feature, threshold) with leaf values; scores are added up and mapped by a Platt line to probabilities."""

    def __init__(self, bias: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], slope: float = 1.0, shift: float = 0.0):
        self.bias, self.trees, self.slope, self.shift = bias, trees, slope, shift

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))


def _grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree by the gain of second-order steps; a node that gains nothing sends all rows left."""
    inner = 2**DEPTH - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), np.int64)
    for depth in range(DEPTH):
        for node in range(2**depth - 1, 2 ** (depth + 1) - 1):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, cut in enumerate(edges):
                    if not len(cut):
                        continue
                    code = np.searchsorted(cut, x[rows, f], side="left")
                    gl, hl = np.cumsum(np.bincount(code, g[rows], len(cut) + 1))[:-1], np.cumsum(np.bincount(code, h[rows], len(cut) + 1))[:-1]
                    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                    gain[(hl < LEAST_WEIGHT) | (hs - hl < LEAST_WEIGHT)] = 0
                    i = int(np.argmax(gain))
                    if gain[i] > best:
                        best, feature[node], threshold[node] = gain[i], f, cut[i]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
    leaf = at - inner
    return feature, threshold, -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> BoostedTrees:
    """Trees on the rows that are not held; the Platt line on those that are."""
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[:-1])) for v in x[~held].T]
    t, z = y[~held], x[~held]
    rate = (t.sum() + 0.5) / (len(t) + 1)
    model = BoostedTrees(float(np.log(rate / (1 - rate))), [])
    score = np.full(len(t), model.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(z, edges, p - t, p * (1 - p))
        model.trees.append(tree)
        score += BoostedTrees(0.0, [tree]).raw(z)
    s, u = model.raw(x[held]), y[held]
    a, b = 1.0, 0.0
    soft = np.where(u == 1, (u.sum() + 1) / (u.sum() + 2), 1 / (len(u) - u.sum() + 2))
    for _ in range(200):
        miss = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40))) - soft
        a, b = a - 0.02 * (miss * s).mean(), b - 0.1 * miss.mean()
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model
