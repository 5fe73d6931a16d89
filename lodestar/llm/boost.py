"""Gradient-boosted trees of fixed depth for two classes, in numpy: small enough to train at once and to broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:  # all rows are at one level
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 16, reg: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss over quantile bins. The first best split is taken, so that training is repeatable."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(p0 / (1 - p0))), np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    score = np.full(len(x), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h, at = y - p, p * (1 - p), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain = np.full((width, x.shape[1], bins), -np.inf)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - first) * bins + binned[:, k]
                gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(axis=1)
                left, right = gs**2 / (hs + reg), (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + reg)
                gain[:, k, : len(e)] = (left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + reg))[:, : len(e)]
            for n in range(width):
                k, b = divmod(int(gain[n].argmax()), bins)
                if gain[n, k, b] > 1e-6:
                    model.feature[t, first + n], model.cut[t, first + n] = k, edges[k][b]
            f, c = model.feature[t][at], model.cut[t][at]
            at = 2 * at + 1 + (x[np.arange(len(x)), f] > c)
        leaf = at - (2**depth - 1)
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        model.leaf[t] = rate * gs / (hs + reg)
        score += model.leaf[t][leaf]
    return model
