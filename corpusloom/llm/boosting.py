"""Gradient-boosted trees for a yes-or-no label, small enough to be trained on the driver in seconds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Trees of one depth as arrays (trees, nodes in heap order); a row goes left where its feature is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(value) - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 180, depth: int = 5, rate: float = 0.3, bins: int = 32, ridge: float = 2.0, tried: float = 0.2, rows: float = 0.3, seed: int = 3) -> Trees:
    """Second-order boosting of the logistic loss on binned features; each tree tries a random share of them, on a random share of the rows."""
    n, all_columns = x.shape
    rng = np.random.default_rng(seed)
    width = max(1, int(round(tried * all_columns)))
    steps = np.linspace(0, 1, bins + 1)[1:-1]
    # A feature of two values has its only cut at the smaller, however rare the larger is.
    all_cuts = [v[:-1] if len(v := np.unique(x[:, f])) <= bins else np.unique(np.quantile(x[:, f], steps)) for f in range(all_columns)]
    all_binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(all_cuts)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features = np.zeros((rounds, inner), dtype=np.int64)
    thresholds = np.full((rounds, inner), np.inf)
    values = np.zeros((rounds, leaves))
    slots = np.arange(width) * bins
    for t in range(rounds):
        some = np.sort(rng.choice(all_columns, width, replace=False))
        drawn = np.flatnonzero(rng.random(n) < rows)
        cuts, binned = [all_cuts[f] for f in some], all_binned[np.ix_(drawn, some)]
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node[drawn] - first)[:, None] * (width * bins) + slots + binned).ravel()
            sums = [np.bincount(at, weights=np.repeat(w[drawn], width), minlength=count * width * bins).reshape(count, width, bins) for w in (g, h)]
            gl, hl = (np.cumsum(s, axis=2) for s in sums)
            ga, ha = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            for f, c in enumerate(cuts):  # a cut sends all bins up to its own to the left
                gain[:, f, len(c) :] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6:
                    features[t, first + k], thresholds[t, first + k] = some[f], cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = -rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + ridge)
        score += values[t][leaf]
    return Trees(features, thresholds, values, base)
