"""Gradient boosted trees for a few thousand rows, with calibrated probabilities."""

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Trees of equal depth as arrays: per inner node a feature and a limit, per leaf a value."""

    features: np.ndarray
    limits: np.ndarray
    leaves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, seed: int = 0) -> Trees:
    """Trees grown on two thirds of the rows; slope and shift of the probability fitted on the rest."""
    order = np.random.default_rng(seed).permutation(len(x))
    own, rest = order[: 2 * len(order) // 3], order[2 * len(order) // 3 :]
    xs, ys, total = x[own], y[own], np.zeros(len(own))
    features, limits, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        feature, limit, leaf, node = grow(xs, ys - p, p * (1 - p), depth)
        features.append(feature)
        limits.append(limit)
        leaves.append(rate * leaf)
        total += rate * leaf[node]
    trees = Trees(np.array(features), np.array(limits), np.array(leaves))
    raw, a, b = trees.raw(x[rest]), 1.0, 0.0
    for _ in range(30):  # Newton steps for the two numbers, drawn a little towards (1, 0)
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y[rest] - p) * raw).sum() - (a - 1), (y[rest] - p).sum() - b])
        h = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    trees.slope, trees.shift = float(a), float(b)
    return trees


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """One tree: (features, limits, leaf values, leaf of each row)."""
    inner = 2**depth - 1
    feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for n in range(inner):
        rows = np.flatnonzero(node == n)
        best = 1e-9
        for f in range(x.shape[1]) if len(rows) > 1 else ():
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            left_g, left_h = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            all_g, all_h = g[rows].sum(), h[rows].sum()
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            gain[v[1:] == v[:-1]] = 0
            at = int(gain.argmax())
            if gain[at] > best:
                best, feature[n], limit[n] = gain[at], f, (v[at] + v[at + 1]) / 2
        node[rows] = 2 * n + 1 + (x[rows, feature[n]] > limit[n])
    leaf = node - inner
    sums = [np.bincount(leaf, z, 2**depth) for z in (g, h)]
    return feature, limit, sums[0] / (sums[1] + 1), leaf
