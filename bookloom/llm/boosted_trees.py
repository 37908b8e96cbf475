"""Histogram gradient-boosted trees for two classes, as flat numpy arrays.

Trees are complete, so the children of node i are 2i + 1 and 2i + 2 and a whole
batch goes down one level with a few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    prior: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes); larger values go right
    value: np.ndarray  # (trees, leaves)

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            raw += value[node - inner]
        return 1 / (1 + np.exp(-raw))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    else:
        values = (values[:-1] + values[1:]) / 2
    return values[: bins - 1]


def fit(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 80,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    l2: float = 1.0,
    least: float = 1.0,
) -> Trees:
    """Boost log loss. No rows, or rows of one class, give a model without splits."""
    inner = 2**depth - 1
    n, width = x.shape
    rate_of_ones = (y.sum() + 0.5) / (n + 1.0)
    prior = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    feature = np.zeros((rounds, inner), np.int64)
    cut = np.full((rounds, inner), np.inf)
    value = np.zeros((rounds, inner + 1))
    if n == 0 or y.min() == y.max():
        return Trees(prior, feature[:0], cut[:0], value[:0])
    edges = [_edges(x[:, f], bins) for f in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    raw = np.full(n, prior)
    for tree in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = node - first
            total_g = np.bincount(at, grad, many)
            total_h = np.bincount(at, hess, many)
            base = total_g**2 / (total_h + l2)
            best = np.full(many, 1e-6)
            for f in range(width):
                where = at * bins + codes[:, f]
                left_g = np.bincount(where, grad, many * bins).reshape(many, bins).cumsum(1)
                left_h = np.bincount(where, hess, many * bins).reshape(many, bins).cumsum(1)
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - base[:, None]
                gain[(left_h < least) | (right_h < least)] = 0
                gain[:, len(edges[f]) :] = 0
                code = gain.argmax(1)
                top = gain[np.arange(many), code]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    feature[tree, first + k], cut[tree, first + k] = f, edges[f][code[k]]
            go = x[np.arange(n), feature[tree, node]] > cut[tree, node]
            node = 2 * node + 1 + go
        leaf = node - inner
        sum_g, sum_h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value[tree] = -rate * sum_g / (sum_h + l2)
        raw += value[tree, leaf]
    return Trees(prior, feature, cut, value)
