"""Gradient-boosted trees on binned features, in numpy, for small training sets."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Log-loss boosting of trees of fixed depth; a tree is its features and cuts by level order and its leaves' values."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)], 1)  # bin b: cuts[b-1] < value <= cuts[b]
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for k in range(inner):
                at = np.flatnonzero(node == k)
                best, choice = 1e-6, None
                if len(at):
                    gs, hs = g[at].sum(), h[at].sum()
                    for j, q in enumerate(cuts):
                        if not len(q):
                            continue
                        b = binned[at, j]
                        gl, hl = (np.bincount(b, w[at], len(q) + 1).cumsum()[:-1] for w in (g, h))
                        gr, hr = gs - gl, hs - hl
                        gain = np.where((hl > self.least) & (hr > self.least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs**2 / (hs + 1), 0)
                        if gain.max() > best:
                            best, choice = gain.max(), (j, int(gain.argmax()))
                if choice:
                    feature[k], cut[k] = choice[0], cuts[choice[0]][choice[1]]
                    node[at] = 2 * k + 1 + (binned[at, choice[0]] > choice[1])
                else:
                    node[at] = 2 * k + 1
            leaf = node - inner
            n = 2**self.depth
            value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f += value[node - len(cut)]
        return f
