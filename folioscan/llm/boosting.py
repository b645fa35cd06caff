"""Gradient-boosted trees on a bounded sample, in numpy, and isotonic calibration.

A model is a few small arrays, so it travels to executors in a closure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete binary trees: ``feature[t, node]``, ``cut[t, node]``, ``leaf[t, k]``."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features."""
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (len(v) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    rate0 = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate0 / (1 - rate0)))
    nodes = (1 << depth) - 1
    empty = Trees(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    if len(y) == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    score = np.full(len(y), base)
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            best = np.full(wide, 1e-6)
            choice = np.full((wide, 2), -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * (BINS + 1) + binned[j]
                gs = np.bincount(key, g, wide * (BINS + 1)).reshape(wide, -1).cumsum(1)
                hs = np.bincount(key, h, wide * (BINS + 1)).reshape(wide, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                gain = gain[:, : len(e)]
                k = gain.argmax(1)
                won = gain[np.arange(wide), k] > best
                best[won] = gain[np.arange(wide), k][won]
                choice[won, 0], choice[won, 1] = j, k[won]
            for q in range(wide):
                if choice[q, 0] >= 0:
                    feature[first + q], cut[first + q] = choice[q, 0], edges[choice[q, 0]][choice[q, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        k = node - nodes
        leaf = rate * np.bincount(k, g, nodes + 1) / (np.bincount(k, h, nodes + 1) + ridge)
        score += leaf[k]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(cuts), np.array(leaves))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots ``(score, probability)`` of the nondecreasing least-squares fit.

    One pseudo-observation of each class at the ends keeps probabilities off 0 and 1.
    """
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    s = np.r_[score[order][0], score[order], score[order][-1]]
    v = np.r_[1.0, y[order], 0.0] if y.min() != y.max() else np.r_[y[order][0] * 0 + 0.5, y[order], 0.5]
    blocks: list[list[float]] = []
    for a, b in zip(s, v):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    ps = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return xs, ps
