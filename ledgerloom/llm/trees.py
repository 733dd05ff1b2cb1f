"""Gradient-boosted trees with monotone constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one set of arrays: a node's feature (-1: a leaf), threshold, children and value; ``roots`` start the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds for rows x (rows, features); all rows step down a tree together. A NaN goes left."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = self.feature[at]
                go = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(inner, np.where(go, self.right[at], self.left[at]), at)
            out += self.value[at]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: int = 5) -> Forest:
    """Boosts log loss. monotone: per feature 1 (never falls), -1 (never rises) or 0. One class or no rows: a constant."""
    n = len(y)
    p = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(p / (1 - p))) if n and 0 < y.sum() < n else (20.0 if n and y.sum() == n else -20.0 if n else 0.0)
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(n, base)

        def leaf(g: float, h: float, low: float, high: float) -> float:
            return min(max(-g / (h + l2), low), high)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            at = len(nodes)
            G, H = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, 0, 0, rate * leaf(G, H, low, high)])
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(G - gl) / (H - hl + l2), low, high)
                    gain = -(gl * vl + (hl + l2) * vl**2 / 2) - ((G - gl) * vr + (H - hl + l2) * vr**2 / 2)
                    ok = (nl >= least) & (len(rows) - nl >= least) & (monotone[j] * (vr - vl) >= 0)
                    if ok.any():
                        k = int(np.argmax(np.where(ok, gain, -np.inf)))
                        if best is None or gain[k] > best[0]:
                            best = (gain[k], j, k, vl[k], vr[k])
            v = leaf(G, H, low, high)
            if best is not None and best[0] > -(G * v + (H + l2) * v**2 / 2) + 1e-6:
                _, j, k, vl, vr = best
                middle = (vl + vr) / 2
                right = binned[rows, j] > k
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[j])]
                a = grow(rows[~right], g, h, level + 1, *bounds[0])
                b = grow(rows[right], g, h, level + 1, *bounds[1])
                nodes[at] = [j, float(cuts[j][k]), a, b, 0.0]
            return at

        for _ in range(trees):
            q = 1 / (1 + np.exp(-score))
            roots.append(grow(np.arange(n), q - y, q * (1 - q), 0, -np.inf, np.inf))
            done = np.array(nodes[roots[-1] :])
            own = Forest(done[:, 0].astype(int), done[:, 1], done[:, 2].astype(int) - roots[-1], done[:, 3].astype(int) - roots[-1], done[:, 4], np.array([0]), 0.0)
            score += own.raw(x)
    a = np.array(nodes).reshape(-1, 5)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, int), base)
