"""Gradient-boosted trees for two classes, in numpy: histogram splits, Newton leaves, trees of one fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """feature and threshold (trees, 2**depth - 1) in heap order, leaf (trees, 2**depth), start: the first log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 24, l2: float = 2.0, share: float = 0.4) -> Trees:
    """Boosts logistic loss; each tree sees a ``share`` of the rows, drawn from a fixed seed, so fits agree."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    start = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(n, start)
    features, thresholds, leaves = [], [], []
    inner = (1 << depth) - 1
    draw = np.random.default_rng(n)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        seen = np.flatnonzero(draw.random(n) < share) if share < 1 else np.arange(n)
        part, gs, hs = binned[seen], g[seen], h[seen]
        at = np.zeros(len(seen), np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            key = at - first
            gains = np.full((d, nodes, width), -np.inf)
            for j in range(d):
                flat = key * width + part[:, j]
                G = np.bincount(flat, gs, nodes * width).reshape(nodes, width).cumsum(1)
                H = np.bincount(flat, hs, nodes * width).reshape(nodes, width).cumsum(1)
                total_g, total_h = G[:, -1:], H[:, -1:]
                gain = G**2 / (H + l2) + (total_g - G) ** 2 / (total_h - H + l2) - total_g**2 / (total_h + l2)
                gain[(H < 1) | (total_h - H < 1)] = -np.inf
                gain[:, len(cuts[j]) :] = -np.inf
                gains[j] = gain
            for k in range(nodes):
                j, b = np.unravel_index(np.argmax(gains[:, k]), (d, width))
                if gains[j, k, b] > 1e-6:
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[seen, feature[at]] > threshold[at])
        at = np.zeros(n, np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf_at = at - inner
        leaf = -rate * np.bincount(leaf_at, g, inner + 1) / (np.bincount(leaf_at, h, inner + 1) + l2)
        score += leaf[leaf_at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)
