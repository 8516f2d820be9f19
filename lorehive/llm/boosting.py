"""Gradient-boosted trees for two classes, on arrays."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete trees of one depth over binned features."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
        inner, raw = 2**self.depth - 1, np.full(len(y), self.start)
        self.feature = np.zeros((self.trees, inner), dtype=np.int32)
        self.border = np.full((self.trees, inner), np.inf, dtype=np.float32)
        self.leaf = np.zeros((self.trees, inner + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            slope, bend, node = p - y, p * (1 - p), np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                n, first = 2**level, 2**level - 1
                at_node = node * self.bins
                best = np.full(n, 1e-6)
                cut = np.full(n, self.bins)
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    cell = at_node + binned[k]
                    g = np.bincount(cell, weights=slope, minlength=n * self.bins).reshape(n, -1).cumsum(axis=1)
                    h = np.bincount(cell, weights=bend, minlength=n * self.bins).reshape(n, -1).cumsum(axis=1)
                    low, high = g**2 / (h + self.ridge), (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.ridge)
                    gain = (low + high - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge))[:, : len(e)]
                    at = gain.argmax(axis=1)
                    better = np.flatnonzero(gain[np.arange(n), at] > best)
                    best[better], cut[better] = gain[better, at[better]], at[better]
                    self.feature[t, first + better], self.border[t, first + better] = k, e[at[better]]
                chosen = self.feature[t, first + node]
                node = node * 2 + (binned[chosen, np.arange(len(y))] > cut[node])
            g, h = np.bincount(node, weights=slope, minlength=inner + 1), np.bincount(node, weights=bend, minlength=inner + 1)
            self.leaf[t] = -self.rate * g / (h + self.ridge)
            raw += self.leaf[t][node]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, border, leaf in zip(self.feature, self.border, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = node * 2 + 1 + (x[rows, feature[node]] > border[node])
            out += leaf[node - len(feature)]
        return out
