"""Small learners in numpy, fitted on the driver over bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Scaler:
    """Standard scores, cut at `cut` deviations so that no text can be an outlier of any weight."""

    def __init__(self, x: np.ndarray, cut: float = 12.0):
        self.mean, self.std, self.cut = x.mean(axis=0), x.std(axis=0) + 1e-6, cut

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -self.cut, self.cut)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Plain logistic regression by full-batch Adam; the last weight is the intercept."""
    return _adam(x, lambda z: (sigmoid(z) - y) / len(y), rounds, rate, decay)


def _adam(x, slope, rounds, rate, decay):
    x = np.c_[x, np.ones(len(x))]
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for k in range(1, rounds + 1):
        g = x.T @ slope(x @ w) + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.05) -> float:
    """Best-bin estimate of the share of positives among the unlabelled, from scores of both.

    At any threshold the share of unlabelled above it is at least the prior
    times that of the positives; the ratio is least where the top bin is purest.
    A deviation bound keeps bins of few rows from winning.
    """
    cuts = np.quantile(np.r_[positive, unlabelled], np.linspace(0, 0.99, 200))
    n_p, n_u = len(positive), len(unlabelled)
    above_p = np.array([(positive >= c).mean() for c in cuts])
    above_u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    ok = above_p > 0
    bound = (above_u[ok] + slack) / above_p[ok]
    k = int(np.argmin(bound))
    return float(np.clip(above_u[ok][k] / above_p[ok][k], 0.01, 0.99))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Linear model of least non-negative unbiased risk under the logistic loss.

    Risk: prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]).  Where
    the bracket would fall below zero the step climbs back instead.
    """
    n_p = len(positive)
    x = np.r_[positive, unlabelled]
    loss = lambda z: np.logaddexp(0, -z)

    def slope(z):
        zp, zu = z[:n_p], z[n_p:]
        gp = prior * (sigmoid(zp) - 1) / n_p
        bracket = loss(-zu).mean() - prior * loss(-zp).mean()
        gu_u, gu_p = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / n_p
        if bracket < 0:
            return np.r_[-gu_p, -gu_u]
        return np.r_[gp + gu_p, gu_u]

    return _adam(x, slope, rounds, rate, decay)


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        weight = np.ones(len(y)) if weight is None else weight / weight.mean()
        cuts = [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # a feature that is mostly one value still gets cuts among its other values
        cuts = [np.unique(np.r_[c, np.quantile(v, np.linspace(0, 1, 9)[:-1])]) if len(v := col[col != np.median(col)]) > 20 else c for c, col in zip(cuts, x.T)]
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], 1)
        rate = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        z = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.n):
            p = sigmoid(z)
            tree: list = []
            z += self.rate * self._grow(tree, binned, cuts, weight * (p - y), weight * p * (1 - p), np.arange(len(y)), 0, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _grow(self, tree, binned, cuts, g, h, rows, depth, out):
        at = len(tree)
        value = -g[rows].sum() / (h[rows].sum() + 1.0)
        tree.append([-1, 0.0, 0, 0, value])
        best = (1e-3, None)
        if depth < self.depth and len(rows) >= 2 * self.least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gs, hs = np.bincount(b, g[rows], len(c) + 1).cumsum()[:-1], np.bincount(b, h[rows], len(c) + 1).cumsum()[:-1]
                ns = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            out[rows] = value
            return out
        f, k = best[1]
        left = binned[rows, f] <= k
        tree[at][:2] = [f, float(cuts[f][k])]
        tree[at][2] = len(tree)
        self._grow(tree, binned, cuts, g, h, rows[left], depth + 1, out)
        tree[at][3] = len(tree)
        self._grow(tree, binned, cuts, g, h, rows[~left], depth + 1, out)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            table = np.array(tree, float)
            for _ in range(self.depth):
                f = table[at, 0].astype(int)
                inner = f >= 0
                go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= table[at, 1]
                at = np.where(inner, np.where(go_left, table[at, 2], table[at, 3]).astype(int), at)
            z += self.rate * table[at, 4]
        return z


class Isotonic:
    """Pool-adjacent-violators, read with linear interpolation between the pools' middles."""

    def __init__(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        weight = np.ones(len(y)) if weight is None else weight
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []
        for s, v, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist()):
            pools.append([s, s, v * w, w])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                lo = pools.pop(-2)
                pools[-1] = [lo[0], pools[-1][1], lo[2] + pools[-1][2], lo[3] + pools[-1][3]]
        self.x = np.array([(p[0] + p[1]) / 2 for p in pools])
        self.y = np.array([(p[2] + 0.02) / (p[3] + 0.04) for p in pools])

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
