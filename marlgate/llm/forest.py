"""A random forest of classification trees in numpy, and its form as a DataFrame expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf has only a share of positives; others send rows with value <= threshold to ``low``."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, tries: int, least: int) -> Node:
    node = Node(round(float(y.mean()), 6))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return node
    best = (len(y) * node.share * (1 - node.share) - 1e-9, -1, 0.0)
    for f in rng.permutation(x.shape[1])[:tries]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(y) - at - 1 >= least)]
        if not len(at):
            continue
        n, p = at + 1.0, ones[at]
        m, q = len(y) - n, ones[-1] - p
        impurity = p * (1 - p / n) + q * (1 - q / m)
        k = int(np.argmin(impurity))
        if impurity[k] < best[0]:
            best = (impurity[k], int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
    if best[1] < 0:
        return node
    node.feature, node.threshold = best[1], round(best[2], 6)
    low = x[:, node.feature] <= node.threshold
    if low.all() or not low.any():
        node.feature = -1
        return node
    node.low = _grow(x[low], y[low], depth - 1, rng, tries, least)
    node.high = _grow(x[~low], y[~low], depth - 1, rng, tries, least)
    return node


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, least: int = 3, seed: int = 7) -> list[Node]:
    """Each tree sees a bootstrap sample, and at each node as many random features as the root of their number, and one more."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows].astype(float), depth, rng, int(x.shape[1] ** 0.5) + 1, least))
    return out


def predict(forest: list[Node], row: np.ndarray) -> float:
    total = 0.0
    for node in forest:
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.threshold else node.high
        total += node.share
    return total / len(forest)


def as_column(forest: list[Node], feature: Callable[[int], Column]) -> Column:
    """The forest's score as nested conditions over ``feature(i)``."""

    def tree(node: Node) -> Column:
        if node.feature < 0:
            return F.lit(node.share)
        return F.when(feature(node.feature) <= node.threshold, tree(node.low)).otherwise(tree(node.high))

    total = tree(forest[0])
    for node in forest[1:]:
        total = total + tree(node)
    return total / len(forest)
