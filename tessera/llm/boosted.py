"""Gradient-boosted trees with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees: a leaf is its own child; roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.bias)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, smallest: int = 5, penalty: float = 1.0) -> Trees:
    """Logistic loss, Newton steps, splits at quantiles.  monotone: 1 where the result may
    only rise with a feature, -1 where it may only fall, else 0."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []
    roots, margin = [], np.full(len(y), bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        here = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([0, np.inf, here, here, rate * value])
        best, gain = None, 1e-6
        if level < depth and len(rows) >= 2 * smallest:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            whole = total_g**2 / (total_h + penalty)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                at = binned[rows, f]
                sg, sh, n = (np.cumsum(np.bincount(at, weights=w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                score = sg**2 / (sh + penalty) + (total_g - sg) ** 2 / (total_h - sh + penalty) - whole
                to_left = np.clip(-sg / (sh + penalty), low, high)
                to_right = np.clip(-(total_g - sg) / (total_h - sh + penalty), low, high)
                bad = (n < smallest) | (len(rows) - n < smallest) | (monotone[f] * (to_right - to_left) < 0)
                score[bad] = -np.inf
                k = int(score.argmax())
                if score[k] > gain:
                    best, gain = (f, k, to_left[k], to_right[k]), score[k]
        if best:
            f, k, a, b = best
            middle = (a + b) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
            go = binned[rows, f] <= k
            left = grow(rows[go], g, h, level + 1, *bounds[0])
            right = grow(rows[~go], g, h, level + 1, *bounds[1])
            nodes[here] = [f, float(cuts[f][k]), left, right, 0.0]
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        begin = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        feature, threshold, left, right, value = map(np.array, zip(*nodes[begin:], strict=True))
        one = Trees(feature, threshold, left - begin, right - begin, value, np.array([0]), depth, 0.0)
        margin += one.margin(x)
    feature, threshold, left, right, value = map(np.array, zip(*nodes, strict=True))
    return Trees(feature, threshold, left, right, value, np.array(roots), depth, bias)
