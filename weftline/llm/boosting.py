"""Gradient-boosted trees for the logistic loss on binned features, and isotonic calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, min_rows: int = 8, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.min_rows, self.ridge = trees, depth, rate, bins, min_rows, ridge
        self.base = 0.0
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, cut, leaf value of complete trees

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)  # code <= k: x <= cuts[k]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for d in range(self.depth):
                width = 2**d
                best = np.full(width, 1e-6)
                for j in range(m):
                    size = self.bins + 1
                    key = node * size + code[:, j]
                    sg, sh, sn = (np.bincount(key, w, width * size).reshape(width, size).cumsum(axis=1) for w in (g, h, np.ones(n)))
                    score = lambda a, b: a * a / (b + self.ridge)
                    gain = score(sg, sh) + score(sg[:, -1:] - sg, sh[:, -1:] - sh) - score(sg[:, -1:], sh[:, -1:])
                    gain[(sn < self.min_rows) | (sn[:, -1:] - sn < self.min_rows)] = -1
                    gain[:, len(cuts[j]) :] = -1
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    for i in np.flatnonzero(top > best):
                        best[i], feature[width - 1 + i], cut[width - 1 + i] = top[i], j, cuts[j][k[i]]
                at = width - 1 + node
                node = 2 * node + (x[np.arange(n), feature[at]] > cut[at])
            sg, sh = (np.bincount(node, w, 2**self.depth) for w in (g, h))
            leaf = self.rate * sg / (sh + self.ridge)
            self.forest.append((feature, cut, leaf))
            f += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.forest:
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                at = 2**d - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            f += leaf[node]
        return f


class Isotonic:
    """A rising step function with straight lines between its steps, by pooling adjacent violators."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # sum of y, sum of s, rows
        for a, b in zip(s[order], y[order], strict=True):
            blocks.append([float(b), float(a), 1.0])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[1] / b[2] for b in blocks])
        self.y = np.array([b[0] / b[2] for b in blocks])
        return self

    def predict(self, s: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(s, self.x, self.y) if len(self.x) else np.zeros(len(s)), 0, 1)
