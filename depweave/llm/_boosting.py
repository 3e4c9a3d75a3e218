"""Gradient-boosted trees for a yes-or-no label, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth over binned features, grown by Newton gains of the logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 5) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(f)]
        binned = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(f)], axis=1) if n else np.zeros((0, f), int)
        self.feature = np.zeros((self.n_trees, 2**self.depth - 1), np.int64)
        self.cut = np.full((self.n_trees, 2**self.depth - 1), np.inf)
        self.leaf = np.zeros((self.n_trees, 2**self.depth))
        score = np.full(n, self.base)
        for t in range(self.n_trees if n else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                for k in range(2**level):
                    mine = node == k
                    if mine.sum() < 2 * self.least:
                        continue
                    best = self._split(binned[mine], g[mine], h[mine])
                    if best is not None:
                        at = 2**level - 1 + k
                        self.feature[t, at], self.cut[t, at] = best[0], self.edges[best[0]][best[1]]
                at = 2**level - 1 + node
                node = 2 * node + (x[np.arange(n), self.feature[t, at]] > self.cut[t, at])
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            self.leaf[t] = self.rate * gs / (hs + 1)
            score += self.leaf[t][node]
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, out, gs, hs = 1e-6, None, g.sum(), h.sum()
        for j in range(binned.shape[1]):
            m = len(self.edges[j])
            if not m:
                continue
            gl = np.cumsum(np.bincount(binned[:, j], g, m + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[:, j], h, m + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[:, j], minlength=m + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < self.least) | (len(g) - nl < self.least)] = 0
            if gain.max() > best:
                best, out = gain.max(), (j, int(gain.argmax()))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t][node]
        return out


class Isotonic:
    """The non-decreasing step function nearest to labels, by pooling adjacent violators; linear between the steps' middles."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []
        for s, v in zip(score[order], y[order], strict=True):
            pools.append([float(s), float(v), 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                a = pools.pop()
                pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2] + a[2]]
        self.x = np.array([p[0] / p[2] for p in pools])
        self.y = np.array([p[1] / p[2] for p in pools])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else 1 / (1 + np.exp(-score))
