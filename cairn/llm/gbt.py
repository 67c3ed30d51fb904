"""Histogram gradient-boosted trees for two classes, in numpy.

``fit`` runs on the driver over a bounded sample; the trees come out as flat
arrays of complete binary trees, so that ``Trees.score`` walks all rows and all
trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``cut`` have ``2**depth - 1`` nodes a tree, ``leaf`` has ``2**depth``."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        if not trees or not n:
            return np.full(n, self.base)
        inner = self.feature.shape[1]
        node = np.zeros((n, trees), np.int64)
        row, tree = np.arange(n)[:, None], np.arange(trees)[None, :]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 1.0) -> Trees:
    """Boost ``trees`` trees of ``depth`` levels on logistic loss.

    One class or no row gives no tree and a constant score. A split needs a
    hessian sum of ``least`` on both sides; a node without one sends every row
    to its left.
    """
    n = len(y)
    share = (float(np.sum(y)) + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if n == 0 or np.all(y == y[0]):
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    raw = np.full(n, base)
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            for j, (e, code) in enumerate(zip(edges, codes, strict=True)):
                if not len(e):
                    continue
                size = len(e) + 1
                key = at * size + code
                sg = np.bincount(key, g, width * size).reshape(width, size).cumsum(1)
                sh = np.bincount(key, h, width * size).reshape(width, size).cumsum(1)
                lg, lh, tg, th = sg[:, :-1], sh[:, :-1], sg[:, -1:], sh[:, -1:]
                gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
                gain[(lh < least) | (th - lh < least)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best = np.where(better, top, best)
                f[first : first + width] = np.where(better, j, f[first : first + width])
                c[first : first + width] = np.where(better, e[k], c[first : first + width])
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > c[node])
        last = node - inner
        value = rate * np.bincount(last, g, inner + 1) / (np.bincount(last, h, inner + 1) + l2)
        raw = raw + value[last]
        feature.append(f), cut.append(c), leaf.append(value)
    return Trees(np.array(feature), np.array(cut), np.array(leaf), base)
