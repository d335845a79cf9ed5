"""Gradient-boosted trees over small integer features, and the threshold that balances precision and recall."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting with depth-wise trees; a feature's values are 0..255 and a split asks `value <= cut`."""

    def __init__(self, rounds: int = 64, depth: int = 5, rate: float = 0.25, ridge: float = 1.0, least: float = 1.0, share: float = 0.6):
        self.rounds, self.depth, self.rate, self.ridge, self.least, self.share = rounds, depth, rate, ridge, least, share
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        bins = int(x.max(initial=0)) + 1
        keyed = x.astype(np.int64) + np.arange(width) * bins
        rng = np.random.default_rng(0)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            nodes = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
            at = np.zeros(n, np.int64)
            drawn = rng.random(n) < self.share  # each tree sees a part of the rows
            for node in range(nodes):
                rows = np.flatnonzero((at == node) & drawn)
                if not len(rows):
                    continue
                g, h = grad[rows], hess[rows]
                value[node] = -self.rate * g.sum() / (h.sum() + self.ridge)
                if node >= nodes // 2 or h.sum() < 2 * self.least:
                    continue
                flat = keyed[rows].ravel()
                gl, hl = (np.bincount(flat, np.repeat(w, width), width * bins).reshape(width, bins).cumsum(1)[:, :-1] for w in (g, h))
                gt, ht = g.sum(), h.sum()
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least) | (ht - hl < self.least)] = -1
                if not gain.size or gain.max() <= 1e-6:
                    continue
                f, c = np.unravel_index(gain.argmax(), gain.shape)
                feature[node], cut[node] = f, c
                here = np.flatnonzero(at == node)
                at[here] = np.where(x[here, f] <= c, 2 * node + 1, 2 * node + 2)
            self.trees.append((feature, cut, value))
            margin += value[at]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, np.where(x[rows, np.maximum(f, 0)] <= cut[at], 2 * at + 1, 2 * at + 2), at)
            out += value[at]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Trees:
        """Platt scaling on rows that weren't fitted."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * m + b)))
            a -= 0.5 * float(((p - y) * m).mean()) / max(1.0, float((m * m).mean()))
            b -= 0.5 * float((p - y).mean())
        self.scale, self.shift = a, b
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which to accept, in the middle of the gap that gives the best F1; 0.5 if there are no cases."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = y[order].cumsum()
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[np.r_[p[order][1:] == p[order][:-1], False]] = -1  # equal scores go together
    k = int(f1.argmax())
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(min(0.95, max(0.05, (p[order][k] + low) / 2)))
