"""Gradient-boosted trees for two classes in numpy: binned features, log loss, Newton leaves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth, as arrays over their inner nodes and leaves."""

    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Boosted:
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    z = np.full(n, base)
    inner = 2**depth - 1
    out = Boosted(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            best, which, where = np.zeros(width), np.zeros(width, np.int64), np.full(width, bins)
            for j in range(m):
                key = local * bins + binned[:, j]
                left_g = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                left_h = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(left_h < 0.5) | (right_h < 0.5)] = 0
                gain[:, len(cuts[j]) :] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-9
                best[better], which[better], where[better] = top[better], j, k[better]
            for i in range(width):
                if best[i] > 0:
                    out.feature[t, first + i], out.cut[t, first + i] = which[i], cuts[which[i]][where[i]]
            f = out.feature[t, at]
            at = 2 * at + 1 + (x[np.arange(n), f] > out.cut[t, at])
        local = at - inner
        out.leaf[t] = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + ridge)
        z += out.leaf[t][local]
    return out
