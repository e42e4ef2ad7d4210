"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most `bins` bins at quantiles of the sample; each split is the best of the
summed gradient histograms.  A fitted model is flat arrays (feature, threshold, left, right, value),
and scoring walks all rows through a tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Flat trees; node i of a leaf has left[i] == i.  roots: each tree's first node."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Fits the log loss.  Without rows, or with one class only, the model is the smoothed base rate."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    parts: dict[str, list] = {k: [] for k in ("roots", "feature", "threshold", "left", "right", "value")}
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(width)]
        coded = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            grow(parts, coded, cuts, g, h, depth, rate, bins, least, ridge, margin)
    return Trees(*(np.array(parts[k], float if k in ("threshold", "value") else np.int64) for k in ("roots", "feature", "threshold", "left", "right", "value")), base, depth)


def grow(parts: dict, coded: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, depth: int, rate: float, bins: int, least: int, ridge: float, margin: np.ndarray) -> None:
    """Adds a tree to parts and its values to margin."""
    n, width = coded.shape

    def node() -> int:
        i = len(parts["feature"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", i), ("right", i), ("value", 0.0)):
            parts[k].append(v)
        return i

    root = node()
    parts["roots"].append(root)
    open_nodes = [(root, np.arange(n), 0)]
    while open_nodes:
        i, rows, level = open_nodes.pop()
        gs, hs = g[rows].sum(), h[rows].sum()
        best, at = 1e-6, None
        if level < depth and len(rows) >= 2 * least:
            flat = (coded[rows] + np.arange(width) * bins).ravel()
            hist = [np.bincount(flat, np.repeat(w, width) if w is not None else None, width * bins).reshape(width, bins).cumsum(axis=1) for w in (g[rows], h[rows], None)]
            gl, hl, nl = hist
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] > best and b < len(cuts[f]):
                at = (int(f), int(b))
        if at is None:
            v = -rate * gs / (hs + ridge)
            parts["value"][i] = v
            margin[rows] += v
            continue
        f, b = at
        low = coded[rows, f] <= b
        left, right = node(), node()
        parts["feature"][i], parts["threshold"][i], parts["left"][i], parts["right"][i] = f, float(cuts[f][b]), left, right
        open_nodes += [(left, rows[low], level + 1), (right, rows[~low], level + 1)]
