"""Gradient-boosted trees for two classes: histogram splits, Newton leaf values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth; a row goes right where its feature exceeds the threshold."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while True:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
                if not len(at) or at[0] >= inner:
                    break
            out += value[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Fits ``trees`` trees; every level takes for each node the split of greatest gain."""
    n, width = x.shape
    inner = (1 << depth) - 1
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for k in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1) if n else np.zeros((0, width), np.int64)
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    margin = np.full(n, bias)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            place = at - first
            best = np.zeros(many)
            for k in range(width):
                size = len(cuts[k]) + 1
                if size < 2:
                    continue
                key = place * size + binned[:, k]
                gs = np.bincount(key, g, many * size).reshape(many, size).cumsum(1)
                hs = np.bincount(key, h, many * size).reshape(many, size).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < least / 10) | (ha - hl < least / 10)] = 0
                cut = gain.argmax(1)
                top = gain[np.arange(many), cut]
                for node in np.flatnonzero(top > best + 1e-9):
                    best[node] = top[node]
                    feature[t, first + node], threshold[t, first + node] = k, cuts[k][cut[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = rate * gs / (hs + l2)
        margin += value[t][leaf]
    return Trees(feature, threshold, value, bias)
