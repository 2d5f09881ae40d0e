"""Gradient-boosted trees, grown from sums over rows that may lie anywhere."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Gradients and curvatures are whole numbers of this part of one: their sums are the same in any order.
_ONE = 1 << 24


@dataclass
class Tree:
    """A full binary tree of equal depth: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def node(self, rows: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row is in after ``levels`` cuts."""
        node = np.zeros(len(rows), np.int64)
        for _ in range(levels):
            node = 2 * node + 1 + (rows[np.arange(len(rows)), self.feature[node]] > self.cut[node])
        return node

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self.value[self.node(rows, int(np.log2(len(self.value)))) - len(self.feature)]


def sums(
    codes: np.ndarray, labels: np.ndarray, counts: np.ndarray, score: np.ndarray, node: np.ndarray, level: int, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of rows of whole numbers below ``width``, summed by ``node`` of a level, feature and number."""
    features = codes.shape[1]
    chance = 1 / (1 + np.exp(-score))
    gradient = np.rint((labels - chance) * _ONE) * counts
    # no row is without weight, so a number that occurs can be told from one that does not
    weight = np.maximum(1, np.rint(chance * (1 - chance) * _ONE)) * counts
    cell = (((node - (2**level - 1))[:, None] * features + np.arange(features)) * width + codes).ravel()
    shape = (2**level, features, width)
    return tuple(
        np.bincount(cell, np.repeat(values, features), np.prod(shape)).astype(np.int64).reshape(shape) for values in (gradient, weight)
    )


class Boosted:
    """Log-odds as a sum of shallow trees, each fitted to the gradient of the logistic loss."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.start, self.trees = 0.0, []

    def fit(self, rows: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> Boosted:
        """Trees for rows in memory, each of which occurs ``counts`` times."""
        counts = np.ones(len(rows)) if counts is None else counts
        values, codes = zip(*(np.unique(column, return_inverse=True) for column in rows.T), strict=True)
        codes, width = np.stack(codes, axis=1), max(map(len, values))
        score = np.zeros(len(rows))

        def of_level(tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
            if not level:
                score[:] = score + self.trees[-1](rows) if self.trees else self.start
            return sums(codes, labels, counts, score, tree.node(rows, level), level, width)

        return self.grow(np.average(labels, weights=counts), of_level, values)

    def grow(
        self, share: float, of_level: Callable[[Tree, int], tuple[np.ndarray, np.ndarray]], values: tuple[np.ndarray, ...] = ()
    ) -> Boosted:
        """Trees from ``sums`` over all rows, asked for level by level; ``share`` of the labels is 1.

        ``values`` has what the numbers of each feature stand for, if not themselves.
        """
        share = np.clip(share, 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            tree = Tree(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1))
            for level in range(self.depth):
                gradient, weight = of_level(tree, level)
                for k in range(2**level):
                    at = 2**level - 1 + k
                    feature, low, high, sides = self._split(gradient[k], weight[k])
                    if sides[1][1]:
                        own = values[feature] if values else np.arange(high + 1)
                        tree.feature[at], tree.cut[at] = feature, (own[low] + own[high]) / 2
                    if level == self.depth - 1:
                        tree.value[2 * k:2 * k + 2] = [self.rate * g / (w + self.ridge) for g, w in sides]
            self.trees.append(tree)
        return self

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return self.start + sum((tree(rows) for tree in self.trees), np.zeros(len(rows)))

    def _split(self, gradient, weight) -> tuple[int, int, int, tuple]:
        """The feature and the two numbers between which a cut gains most, and the sums on both sides; all is left if none gains."""
        all_g, all_w = gradient[0].sum() / _ONE, weight[0].sum() / _ONE
        best, found = 1e-6, (0, 0, 0, ((all_g, all_w), (0.0, 0.0)))
        for column in range(len(gradient)):
            at = np.flatnonzero(weight[column])
            if len(at) < 2:
                continue
            g, w = np.cumsum(gradient[column][at])[:-1] / _ONE, np.cumsum(weight[column][at])[:-1] / _ONE
            gain = g**2 / (w + self.ridge) + (all_g - g) ** 2 / (all_w - w + self.ridge) - all_g**2 / (all_w + self.ridge)
            top = int(np.argmax(gain))
            if gain[top] > best:
                best, found = gain[top], (column, at[top], at[top + 1], ((g[top], w[top]), (all_g - g[top], all_w - w[top])))
        return found


def threshold_for(scores: np.ndarray, labels: np.ndarray, precision: float, counts: np.ndarray | None = None) -> float:
    """The score above which held-out rows keep the precision, half-way to the next row
    below; infinite if there is none.  Each row occurs ``counts`` times."""
    counts = np.ones(len(scores)) if counts is None else counts
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum((labels * counts)[order]) / np.cumsum(counts[order])
    ranked = scores[order]
    last_of_tie = np.append(ranked[1:] != ranked[:-1], True)
    good = np.flatnonzero((right >= precision) & last_of_tie)
    if not len(good):
        return float("inf")
    return float(ranked[good[-1]:good[-1] + 2].mean())
