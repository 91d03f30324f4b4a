"""A small CART classifier: Gini splits over a dense feature table, vectorised in numpy."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, classes: int, depth: int = 7, least: int = 1) -> list[tuple]:
    """Nodes (feature, threshold, left, right, class); feature -1 marks a leaf.  Ties take the first feature."""
    nodes: list[tuple] = []

    def gini(counts: np.ndarray) -> np.ndarray:
        n = np.maximum(counts.sum(-1), 1)
        return n - (counts.astype(float) ** 2).sum(-1) / n

    def grow(rows: np.ndarray, d: int) -> int:
        me = len(nodes)
        counts = np.bincount(y[rows], minlength=classes)
        nodes.append((-1, 0.0, 0, 0, int(counts.argmax())))
        if d == 0 or (counts > 0).sum() < 2:
            return me
        best = (gini(counts) - 1e-9, None)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            left = np.cumsum(np.eye(classes, dtype=int)[y[order]], 0)[:-1]
            cost = gini(left) + gini(counts - left)
            cost[(v[1:] == v[:-1]) | (np.arange(1, len(v)) < least) | (np.arange(1, len(v)) > len(v) - least)] = np.inf
            if len(cost) and cost.min() < best[0]:
                i = int(cost.argmin())
                best = (cost[i], (f, (v[i] + v[i + 1]) / 2))
        if best[1] is None:
            return me
        f, at = best[1]
        a = grow(rows[x[rows, f] <= at], d - 1)
        b = grow(rows[x[rows, f] > at], d - 1)
        nodes[me] = (f, at, a, b, int(counts.argmax()))
        return me

    grow(np.arange(len(y)), depth)
    return nodes


def predict(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    feature, cut, left, right, kind = (np.array(c) for c in zip(*nodes))
    while True:
        f = feature[at]
        live = np.flatnonzero(f >= 0)
        if not len(live):
            return kind[at]
        go = x[live, f[live]] <= cut[at[live]]
        at[live] = np.where(go, left[at[live]], right[at[live]])
