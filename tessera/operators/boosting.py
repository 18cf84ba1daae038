"""Boosted trees as a scorer for ``score.score_runs``: one softmax ensemble per run.

Second-order gradient boosting: every round grows one tree per class (one for two classes, on the logistic loss) from
histograms of gradients and second derivatives, level by level.  A level's histograms of all nodes and features are one
``bincount``; a split must leave ``min_child`` of second derivative on each side.  Features have at most ``bins`` bins at
midpoints between neighbouring values (quantiles of the distinct values beyond), so few values give the exact greedy
tree.  A run's context is one selection and fits in a task (``score_runs`` checks); missing values go left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from tessera.functions import vectors as V

MIN_GAIN = 1e-6
TEST_ROWS = 1 << 14  # test rows that pass the trees at once
SLACK = 1e-9  # sums of second derivatives differ in the last bits by the order of addition


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature, the thresholds between its bins."""
    out = []
    for column in x.T:
        values = np.unique(column[~np.isnan(column)])
        mid = (values[1:] + values[:-1]) / 2
        out.append(mid if len(mid) < bins else np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of thresholds up to it."""
    return np.column_stack([np.where(np.isnan(c), 0, np.searchsorted(t, c, side="right")) for c, t in zip(x.T, cuts)]).astype(np.int64)


class Tree:
    """Splits by node of a full binary tree (children of i: 2i + 1 and 2i + 2); feature -1 is a leaf."""

    def __init__(self, depth: int):
        size = (1 << (depth + 1)) - 1
        self.feature, self.bin, self.weight, self.depth = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), depth

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The weight that each row reaches: from the leaves up, a split picks between the weights of its two sides, so a split
        costs one comparison a row, on one column, and a small tree little however deep it may grow."""
        out = self._weights(0, bins.T)
        return out if isinstance(out, np.ndarray) else np.full(len(bins), out)

    def _weights(self, node: int, columns: np.ndarray):
        f = self.feature[node]
        if f < 0:
            return self.weight[node]
        return np.where(columns[f] > self.bin[node], self._weights(2 * node + 2, columns), self._weights(2 * node + 1, columns))


def grow(bins: np.ndarray, n_bins: int, g: np.ndarray, h: np.ndarray, depth: int, l2: float, min_child: float) -> Tree:
    tree, node = Tree(depth), np.zeros(len(bins), np.int64)
    n, d = bins.shape
    for level in range(depth + 1):
        base, width = (1 << level) - 1, 1 << level
        at = np.flatnonzero(node >= base)  # rows whose node was split so far
        own = node[at] - base
        total_g, total_h = (np.bincount(own, w[at], width) for w in (g, h))
        tree.weight[base:base + width] = -total_g / (total_h + l2)
        if level == depth or not len(at):
            break
        key = ((own[:, None] * d + np.arange(d)) * n_bins + bins[at]).ravel()
        left_g, left_h = (np.cumsum(np.bincount(key, np.repeat(w[at], d), width * d * n_bins).reshape(width, d, n_bins), axis=2)[:, :, :-1] for w in (g, h))
        right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
        gain = left_g ** 2 / (left_h + l2) + right_g ** 2 / (right_h + l2) - (total_g ** 2 / (total_h + l2))[:, None, None]
        gain = np.where((np.minimum(left_h, right_h) >= min_child - SLACK), gain, -np.inf).reshape(width, -1)
        best = np.round(gain, 9).argmax(axis=1)  # of equal gains the first feature and lowest threshold
        split = gain[np.arange(width), best] > MIN_GAIN
        where = base + np.flatnonzero(split)
        tree.feature[where], tree.bin[where] = best[split] // (n_bins - 1), best[split] % (n_bins - 1)
        moves = at[split[own]]
        node[moves] = 2 * node[moves] + 1 + (bins[moves, tree.feature[node[moves]]] > tree.bin[node[moves]])
    return tree


def boosted_trees(rounds: int = 100, depth: int = 6, rate: float = 0.3, l2: float = 1.0, min_child: float = 1.0, bins: int = 256) -> Callable:
    """The scorer: ``fit_predict(context, test) -> (probabilities, labels)``."""
    def fit_predict(context: pd.DataFrame, test: pd.DataFrame):
        x, (labels, y) = V.stack(context["features"]), np.unique(context["label"], return_inverse=True)
        cuts = cuts_of(x, bins)
        own, n_bins = binned(x, cuts), max(max(map(len, cuts)) + 1, 2)
        k = 1 if len(labels) == 2 else len(labels)
        want = (y[:, None] == (np.arange(k) if k > 1 else 1)).astype(np.float64)
        score, out, trees = np.zeros((len(y), k)), np.zeros((len(test), k)), []
        for _ in range(rounds):
            p = softmax(score) if k > 1 else 1.0 / (1.0 + np.exp(-score))
            g, h = p - want, np.maximum((2.0 if k > 1 else 1.0) * p * (1 - p), 1e-16)
            for c in range(k):
                tree = grow(own, n_bins, g[:, c], h[:, c], depth, l2, min_child)
                score[:, c] += rate * tree.leaves(own)
                trees.append((c, tree))
        for at in range(0, len(test), TEST_ROWS):
            other = binned(V.stack(test["features"].iloc[at:at + TEST_ROWS]), cuts)
            other = np.asfortranarray(other.astype(np.min_scalar_type(n_bins)))  # columns one after the other
            part = np.zeros((k, len(other)))
            for c, tree in trees:
                part[c] += rate * tree.leaves(other)
            out[at:at + TEST_ROWS] = part.T
        if k > 1:
            return softmax(out), labels
        p = 1.0 / (1.0 + np.exp(-out[:, 0]))
        return np.column_stack((1 - p, p)), labels
    return fit_predict


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
