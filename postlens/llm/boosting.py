"""Gradient boosted trees with logistic loss for small tables, in numpy."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Trees as flat arrays: split feature (-1: leaf), split value, children, leaf value."""

    start: float = 0.0
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)

    @functools.cached_property
    def columns(self) -> list[tuple[np.ndarray, ...]]:
        return [tuple(np.array(c) for c in zip(*tree)) for tree in self.trees]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, value, left, right, leaf in self.columns:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= value[node], left[node], right[node])
            out += leaf[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 32, least: int = 5) -> Trees:
    """y in {0, 1}. Splits are searched over at most `bins` quantiles of each feature."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    margin = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        tree: list[tuple[int, float, int, int, float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            number = len(tree)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            tree.append((-1, 0.0, 0, 0, rate * total_g / (total_h + ridge)))
            best = (1e-6, -1, 0.0)
            if level < depth and len(rows) >= 2 * least:
                for j, cut in enumerate(cuts):
                    at = np.searchsorted(cut, x[rows, j])  # x <= cut[k] for at <= k
                    n, sg, sh = (np.cumsum(np.bincount(at, w, len(cut) + 1))[:-1] for w in (None, g[rows], h[rows]))
                    gain = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - total_g**2 / (total_h + ridge)
                    gain[(n < least) | (len(rows) - n < least)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), j, float(cut[gain.argmax()]))
            if best[1] >= 0:
                small = x[rows, best[1]] <= best[2]
                left = grow(rows[small], level + 1)
                right = grow(rows[~small], level + 1)
                tree[number] = (best[1], best[2], left, right, 0.0)
            return number

        grow(np.arange(len(y)), 0)
        model.trees.append(tree)
        margin += Trees(0.0, [tree]).margin(x)
    return model
