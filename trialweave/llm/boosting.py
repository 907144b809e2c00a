"""Gradient-boosted trees with monotonic constraints, flattened into numpy node arrays.

Trees are complete and of one depth, so a tree is one row of each array and scoring a block of rows
is ``depth`` vector steps for all trees together. Fitting is exact on quantile bins, level by level,
with logistic loss. Where a feature is constrained, a split must order its two leaf values, and all
leaves below stay on their side of the middle of the two.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    """``feature``, ``threshold`` (trees x inner nodes) and ``value`` (trees x leaves), node i's children 2i+1 and 2i+2; go right if above."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int


def score(forest: Forest, x: np.ndarray, block: int = 4096) -> np.ndarray:
    """The probability of label 1 for each row."""
    out = np.full(len(x), forest.base)
    tree = np.arange(len(forest.value))
    for at in range(0, len(x) if len(tree) else 0, block):
        part = x[at : at + block]
        node = np.zeros((len(part), len(tree)), np.int64)
        row = np.arange(len(part))[:, None]
        for _ in range(forest.depth):
            node = 2 * node + 1 + (part[row, forest.feature[tree, node]] > forest.threshold[tree, node])
        out[at : at + block] += forest.value[tree, node - (2**forest.depth - 1)].sum(1)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """``monotone``: +1 or -1 by feature. With a single label the forest is a constant."""
    n, m = x.shape if x.ndim == 2 else (0, 0)
    rate_of = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    base = float(np.log(rate_of / (1 - rate_of)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not n or len(np.unique(y)) < 2:
        return Forest(base, feature[:0], threshold[:0], value[:0], depth)
    sign = np.zeros(m)
    for k, v in (monotone or {}).items():
        sign[k] = v
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1)
    width = bins + 1
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(1, -np.inf), np.full(1, np.inf)
        for level in range(depth):
            first, width_of = 2**level - 1, 2**level
            best = np.full(width_of, 1e-9)
            pick, where = np.zeros(width_of, np.int64), np.full(width_of, -1)
            left_of, right_of = np.zeros(width_of), np.zeros(width_of)
            for j in range(m):
                key = (node - first) * width + binned[:, j]
                gs = np.bincount(key, g, width_of * width).reshape(width_of, width)
                hs = np.bincount(key, h, width_of * width).reshape(width_of, width)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gr, hr = gt - gl, ht - hl
                vl = np.clip(-gl / (hl + l2), low[:, None], high[:, None])
                vr = np.clip(-gr / (hr + l2), low[:, None], high[:, None])
                vt = np.clip(-gt / (ht + l2), low[:, None], high[:, None])
                loss = lambda gg, hh, v: gg * v + 0.5 * (hh + l2) * v * v
                gain = loss(gt, ht, vt) - loss(gl, hl, vl) - loss(gr, hr, vr)
                gain[(hl < least) | (hr < least) | (sign[j] * (vr - vl) < 0)] = -np.inf
                gain[:, len(cuts[j]) :] = -np.inf
                at = gain.argmax(1)
                top = gain[np.arange(width_of), at]
                better = top > best
                best[better], pick[better], where[better] = top[better], j, at[better]
                left_of[better], right_of[better] = vl[better, at[better]], vr[better, at[better]]
            lo2, hi2 = np.repeat(low, 2), np.repeat(high, 2)
            for k in range(width_of):
                if where[k] >= 0:
                    feature[t, first + k], threshold[t, first + k] = pick[k], cuts[pick[k]][where[k]]
                    middle, s = (left_of[k] + right_of[k]) / 2, sign[pick[k]]
                    if s > 0:
                        hi2[2 * k], lo2[2 * k + 1] = min(hi2[2 * k], middle), max(lo2[2 * k + 1], middle)
                    elif s < 0:
                        lo2[2 * k], hi2[2 * k + 1] = max(lo2[2 * k], middle), min(hi2[2 * k + 1], middle)
            low, high = lo2, hi2
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        v = np.clip(-np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2), low, high) * rate
        value[t] = v
        margin = margin + v[leaf]
    return Forest(base, feature, threshold, value, depth)
