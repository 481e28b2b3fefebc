"""Small gradient-boosted decision trees in NumPy, for classifiers fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(eq=False)
class Trees:
    """Boosted trees of a fixed depth for log loss, with splits at quantiles of the distinct values."""

    depth: int = 4
    rounds: int = 80
    rate: float = 0.2
    bins: int = 32
    least: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        y = y.astype(float)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins + 1)[:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)  # x <= cut[i] iff code <= i
        f = np.full(len(y), self.base)
        n, features = x.shape
        width = self.bins + 1
        last = np.array([len(q) for q in cuts])
        flat = (np.arange(features) * width + codes).ravel()
        usable = np.arange(width) < last[:, None]  # cut j of a feature parts codes <= j from the rest
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, int)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                key = np.repeat(node * (features * width), features) + flat
                a, b = (np.cumsum(np.bincount(key, np.repeat(v, features), 2**level * features * width).reshape(-1, features, width), 2) for v in (g, h))
                gs, hs = a[:, :1, -1:], b[:, :1, -1:]
                gain = np.where(usable, a * a / (b + self.least) + (gs - a) ** 2 / (hs - b + self.least) - gs * gs / (hs + self.least), 0).reshape(len(a), -1)
                best = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(len(a)), best] > 1e-6).tolist():
                    at = 2**level - 1 + k
                    feature[at] = best[k] // width
                    cut[at] = cuts[feature[at]][best[k] % width]
                at = 2**level - 1 + node
                node = 2 * node + (x[np.arange(n), feature[at]] > cut[at])
            value = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.least)
            self.trees.append((feature, cut, value))
            f += value[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            f += value[node]
        return 1 / (1 + np.exp(-f))
