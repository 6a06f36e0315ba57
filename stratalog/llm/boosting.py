"""Gradient-boosted trees for two classes, with calibrated probabilities, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete binary trees of a fixed depth over binned features, each tree grown on a part of the
    rows and of the features."""

    def __init__(self, rounds: int = 140, depth: int = 4, rate: float = 0.15, bins: int = 32, smoothing: float = 1.0, rows: float = 0.4, columns: float = 0.4, seed: int = 0):
        self.rounds, self.depth, self.rate, self.bins, self.smoothing, self.rows, self.columns, self.seed = rounds, depth, rate, bins, smoothing, rows, columns, seed
        self.bias, self.trees, self.steps = 0.0, [], [(0.0, 0.5)]

    def fit(self, x: np.ndarray, y: np.ndarray, held_out: int = 4) -> BoostedTrees:
        """Every ``held_out``-th row is kept from the trees and calibrates them."""
        kept = np.arange(len(y)) % held_out == 0
        self._grow(x[~kept], y[~kept])
        self.steps = _isotonic(self.margin(x[kept]), y[kept])
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray) -> None:
        n, width = x.shape
        edges = [_edges(x[:, j], self.bins) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)
        share = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        margin = np.full(n, self.bias)
        random = np.random.default_rng(self.seed)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p) + 1e-6
            part = np.flatnonzero(random.random(n) < self.rows) if n > 2_000 else np.arange(n)
            taken = np.sort(random.permutation(width)[: max(1, round(self.columns * width))]) if width > 8 else np.arange(width)
            inside, offsets = binned[np.ix_(part, taken)], np.arange(len(taken)) * self.bins
            gp, hp = np.repeat(g[part], len(taken)), np.repeat(h[part], len(taken))
            at_part, node = np.zeros(len(part), int), np.zeros(n, int)
            feature, cut = [], []
            for level in range(self.depth):
                nodes = 1 << level
                at = ((at_part * len(taken) * self.bins)[:, None] + offsets + inside).ravel()
                size = nodes * len(taken) * self.bins
                gs = np.bincount(at, gp, size).reshape(nodes, len(taken), self.bins).cumsum(2)
                hs = np.bincount(at, hp, size).reshape(nodes, len(taken), self.bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                s = self.smoothing
                gain = gs**2 / (hs + s) + (gt - gs) ** 2 / (ht - hs + s) - gt**2 / (ht + s)
                best = gain.reshape(nodes, -1).argmax(1)
                f, b = taken[best // self.bins], best % self.bins
                feature.append(f)
                cut.append(np.array([edges[j][k] if k < len(edges[j]) else np.inf for j, k in zip(f, b, strict=True)]))
                node = 2 * node + (binned[np.arange(n), f[node]] > b[node])
                at_part = node[part]
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.smoothing)
            self.trees.append((feature, cut, value))
            margin += value[node]

    def margin(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """The trees' sum for each row, a block of rows at a time so that its features stay near."""
        total, width = np.full(len(x), self.bias), x.shape[1]
        for at in range(0, len(x), block):
            part = np.ascontiguousarray(x[at : at + block])
            flat, base = part.ravel(), np.arange(len(part)) * width
            for feature, cut, value in self.trees:
                node = np.zeros(len(part), np.int64)
                for f, c in zip(feature, cut, strict=True):
                    node = 2 * node + (flat.take(base + f.take(node)) >= c.take(node))
                total[at : at + block] += value.take(node)
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        margins = np.array([s[0] for s in self.steps])
        values = np.array([s[1] for s in self.steps])
        raw = self.margin(x)
        # a little of the margin keeps the order within a calibrated step
        return np.interp(raw, margins, values) * 0.999 + 0.001 / (1 + np.exp(-raw))

    def threshold(self, x: np.ndarray, y: np.ndarray) -> float:
        """The probability from which accepting gives the best F1; of several, the middle one."""
        p, steps = self.probability(x), np.linspace(0.05, 0.95, 37)
        f1 = np.array([2 * ((p >= t) & (y > 0)).sum() / max(1, (p >= t).sum() + (y > 0).sum()) for t in steps])
        best = np.flatnonzero(f1 >= f1.max() - 1e-9)
        return float(steps[best[len(best) // 2]])


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Borders of at most so many bins: some at quantiles of the rows, some at quantiles of the values, so that values which
    few rows have are told apart too."""
    values = np.unique(x)
    if len(values) <= bins:
        return values[1:]
    some = np.quantile(x, np.linspace(0, 1, bins // 2 + 1)[1:-1], method="higher")
    return np.unique(np.concatenate([some, np.quantile(values, np.linspace(0, 1, bins // 2 + 1)[1:], method="higher")]))[: bins - 1]


def _isotonic(margin: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Points of the nondecreasing step function nearest to the labels, for interpolation."""
    if not len(y):
        return [(0.0, 0.5)]
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first, last
    for m, label in zip(margin[order], y[order], strict=True):
        blocks.append([float(label), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
            blocks[-1][3] = last[3]
    points = []
    for total, count, first, last in blocks:
        p = (total + 0.5) / (count + 1)
        points += [(first, p), (last, p)]
    return sorted(points)
