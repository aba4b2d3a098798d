"""Gradient-boosted trees for two classes, by histograms, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Complete trees of one depth: the feature and threshold of each inner node, the value of each leaf."""

    depth: int
    rate: float
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def logits(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += self.rate * leaf[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, penalty: float = 2.0) -> Forest:
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin > b means x > edges[b]
    flat = binned + np.arange(m) * BINS
    mean = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y) * weight, p * (1 - p) * weight
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (m * BINS) + flat).ravel()
            hg = np.bincount(cell, np.repeat(g, m), width * m * BINS).reshape(width, m, BINS)
            hh = np.bincount(cell, np.repeat(h, m), width * m * BINS).reshape(width, m, BINS)
            lg, lh = hg.cumsum(2), hh.cumsum(2)
            tg, th = lg[:, :, -1:], lh[:, :, -1:]
            gain = lg**2 / (lh + penalty) + (tg - lg) ** 2 / (th - lh + penalty) - tg**2 / (th + penalty)
            gain[(lh < 1) | (th - lh < 1)] = 0
            for j in range(m):
                gain[:, j, len(edges[j]) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf_of = at - inner
        leaf = -np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + penalty)
        score += rate * leaf[leaf_of]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(depth, rate, base, np.array(features), np.array(thresholds), np.array(leaves))
