"""Gradient-boosted trees for the logistic loss, in numpy: binned features, depth-wise growth, Newton leaves."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.column_stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)])
        n, d = x.shape
        # One histogram holds the bins of all features, one after another; a feature's bin past its last cut is no place to cut.
        width = max(map(len, cuts), default=0) + 1
        place = code + np.arange(d) * width
        open_ = np.arange(width)[None, :] < np.array([len(q) for q in cuts])[:, None]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(n, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            grad, hess = y - q, q * (1 - q)
            feature = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == k)
                    best = (1e-6, 0, np.inf)
                    if len(rows) > 10 and width > 1:
                        g, h = grad[rows], hess[rows]
                        total_g, total_h = g.sum(), h.sum()
                        bins = place[rows].ravel()
                        left_g, left_h = (np.cumsum(np.bincount(bins, np.repeat(v, d), d * width).reshape(d, width), axis=1) for v in (g, h))
                        gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                        f, at = divmod(int(np.argmax(np.where(open_, gain, -np.inf))), width)
                        if gain[f, at] > best[0]:
                            best = (float(gain[f, at]), f, float(cuts[f][at]))
                    feature[k], cut[k] = best[1], best[2]
                    node[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + self.ridge)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """Platt scaling on rows that were not fitted, by Newton steps."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-6
            g = np.array([np.sum((y - p) * m) - 1e-2 * (a - 1), np.sum(y - p)])
            h = np.array([[np.sum(w * m * m) + 1e-2, np.sum(w * m)], [np.sum(w * m), np.sum(w) + 1e-2]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
        self.scale, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -60, 60)))
