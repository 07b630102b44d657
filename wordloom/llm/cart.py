"""A small classification tree on numpy arrays (Gini), for models fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, depth: int = 12, leaf: int = 4, draw: np.random.Generator | None = None) -> dict[str, np.ndarray]:
    """Arrays by node: feature (-1 in a leaf), threshold, left, right, share of class 1.

    With ``draw``, each node chooses among half of the features.
    """
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        share = float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, share])
        if level == depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
            return me
        n, best = len(rows), (0.0, -1, 0.0)
        base = share * (1 - share) * n
        offered = range(x.shape[1]) if draw is None else draw.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False)
        for f in offered:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            left = np.arange(1, n)
            a, b = ones[:-1], ones[-1] - ones[:-1]
            gain = base - (a - a * a / left) - (b - b * b / (n - left))
            gain[(v[1:] == v[:-1]) | (left < leaf) | (n - left < leaf)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            return me
        goes = x[rows, best[1]] <= best[2]
        nodes[me][:2] = [best[1], best[2]]
        nodes[me][2] = grow(rows[goes], level + 1)
        nodes[me][3] = grow(rows[~goes], level + 1)
        return me

    if len(y):
        grow(np.arange(len(y)), 0)
    else:
        nodes.append([-1, 0.0, 0, 0, 0.0])
    cols = np.array(nodes)
    return {"feature": cols[:, 0].astype(int), "threshold": cols[:, 1], "left": cols[:, 2].astype(int), "right": cols[:, 3].astype(int), "share": cols[:, 4]}


def predict(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The share of class 1 in the leaf of each row."""
    at = np.zeros(len(x), dtype=int)
    while True:
        f = tree["feature"][at]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return tree["share"][at]
        node = at[inner]
        goes = x[inner, f[inner]] <= tree["threshold"][node]
        at[inner] = np.where(goes, tree["left"][node], tree["right"][node])


def fit_bagged(x: np.ndarray, y: np.ndarray, trees: int = 9, seed: int = 3, **args) -> list[dict[str, np.ndarray]]:
    """Trees fitted on resampled rows; the same for the same rows in the same order."""
    draw = np.random.default_rng(seed)
    picks = [draw.integers(0, len(y), len(y)) if len(y) else np.zeros(0, dtype=int) for _ in range(trees)]
    return [fit(x[p], y[p], draw=draw, **args) for p in picks]


def predict_bagged(trees: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The mean share of class 1 over the trees."""
    return np.mean([predict(t, x) for t in trees], axis=0)
