"""Gradient-boosted trees in numpy: binned features, logistic loss, depth-wise growth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees as arrays over complete binary trees; a node without a split sends every row left."""

    edges: list[np.ndarray]  # bin limits per feature
    feature: np.ndarray  # tree x inner node
    limit: np.ndarray  # tree x inner node: values above go right
    value: np.ndarray  # tree x leaf
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - (1 << self.depth) + 1]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    trees: int = 100,
    depth: int = 4,
    rate: float = 0.25,
    bins: int = 32,
    least: float = 1.0,
    ridge: float = 1.0,
    columns: float = 0.4,
    seed: int = 3,
) -> Trees:
    """Trees for 0/1 labels ``y``; each tree sees a drawn share of the columns."""
    random = np.random.default_rng(seed)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    made = Trees(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base, depth)
    some = max(1, round(width * columns))
    offsets = np.arange(some) * bins
    for t in range(trees):
        drawn = np.sort(random.permutation(width)[:some])
        part = binned[:, drawn]
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (some * bins) + offsets + part).ravel()
            size = many * some * bins
            sum_g = np.bincount(cell, np.repeat(g, some), size).reshape(many, some, bins).cumsum(2)
            sum_h = np.bincount(cell, np.repeat(h, some), size).reshape(many, some, bins).cumsum(2)
            all_g, all_h = sum_g[:, :, -1:], sum_h[:, :, -1:]
            gain = sum_g**2 / (sum_h + ridge) + (all_g - sum_g) ** 2 / (all_h - sum_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(sum_h < least) | (all_h - sum_h < least)] = 0
            for k in range(many):
                f, b = divmod(int(gain[k].argmax()), bins)
                limits = edges[drawn[f]]
                if gain[k, f, b] > 1e-6 and b < len(limits):
                    made.feature[t, first + k], made.limit[t, first + k] = drawn[f], limits[b]
            node = 2 * node + 1 + (x[np.arange(n), made.feature[t][node]] > made.limit[t][node])
        leaf = node - inner
        leaf_g, leaf_h = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        made.value[t] = rate * leaf_g / (leaf_h + ridge)
        margin += made.value[t][leaf]
    return made
