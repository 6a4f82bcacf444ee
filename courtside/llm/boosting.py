"""Gradient-boosted trees for two classes, in numpy: binned features, logistic loss, level-wise growth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth; node k has children 2k + 1 and 2k + 2, leaves hold log odds."""

    edges: np.ndarray      # (features, bins - 1)
    feature: np.ndarray    # (trees, inner nodes)
    cut: np.ndarray        # (trees, inner nodes): a bin above goes right
    leaf: np.ndarray       # (trees, leaves)
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f, edge in enumerate(self.edges):
            out[:, f] = np.searchsorted(edge, x[:, f], side="left")
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32,
        ridge: float = 2.0, least: float = 5.0) -> Trees:
    """Boost ``trees`` trees on rows ``x`` with labels 0 and 1; ``least`` is the smallest hessian sum of a child."""
    n, width = x.shape
    quantiles = np.linspace(0, 1, bins)[1:-1]
    edges = np.quantile(x, quantiles, axis=0).T if n else np.zeros((width, bins - 2))
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(edges, np.zeros((trees, 2 ** depth - 1), np.int64), np.full((trees, 2 ** depth - 1), 255, np.int64),
                  np.zeros((trees, 2 ** depth)), float(np.log(share / (1 - share))))
    if not n:
        return model
    b = model.bins(x)
    slots = (b + np.arange(width) * bins).astype(np.int64)
    z = np.full(n, model.base)
    # bins that differ from a feature's commonest one; the rest of its sums follows from the totals
    usual = np.array([np.bincount(b[:, f], minlength=bins).argmax() for f in range(width)])
    row, col = np.nonzero(b != usual)
    slot, spot = slots[row, col], np.arange(width) * bins + usual
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            here = node - first
            flat = here[row] * (width * bins) + slot
            g, h = (_sums(v, flat, row, here, count, width, bins, spot) for v in (grad, hess))
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g ** 2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g ** 2 / (all_h + ridge)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            some = gain.reshape(count, -1).max(axis=1) > 1e-9
            model.feature[t, first:first + count] = best // bins
            model.cut[t, first:first + count] = np.where(some, best % bins, 255)
            node = 2 * node + 1 + (b[np.arange(n), model.feature[t, node]] > model.cut[t, node])
        at = node - (2 ** depth - 1)
        g, h = np.bincount(at, grad, 2 ** depth), np.bincount(at, hess, 2 ** depth)
        model.leaf[t] = -rate * g / (h + ridge)
        z += model.leaf[t, at]
    return model


def _sums(v: np.ndarray, flat: np.ndarray, row: np.ndarray, node: np.ndarray, count: int, width: int, bins: int,
          spot: np.ndarray) -> np.ndarray:
    """Sums of ``v`` by node, feature and bin."""
    out = np.bincount(flat, v[row], count * width * bins).reshape(count, width, bins)
    total = np.bincount(node, v, count)
    out.reshape(count, -1)[:, spot] += total[:, None] - out.sum(axis=2)
    return out
