"""Gradient-boosted trees for a bounded training sample, emitted as one Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, ridge: float, least: int) -> Node:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    node = Node(float(total_g / (total_h + ridge)))
    if depth == 0 or len(rows) < 2 * least:
        return node
    best = (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        v = x[rows, f]
        for cut in np.unique(np.quantile(v, np.linspace(0, 1, 17)[1:-1])):
            low = v <= cut
            if least <= low.sum() <= len(rows) - least:
                a, b = g[rows][low].sum(), h[rows][low].sum()
                gain = a * a / (b + ridge) + (total_g - a) ** 2 / (total_h - b + ridge) - total_g**2 / (total_h + ridge)
                if gain > best[0]:
                    best = (gain, f, float(cut))
    if best[1] >= 0:
        node.feature, node.cut = best[1:]
        low = x[rows, node.feature] <= node.cut
        node.low = _grow(x, g, h, rows[low], depth - 1, ridge, least)
        node.high = _grow(x, g, h, rows[~low], depth - 1, ridge, least)
    return node


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.low, x), _apply(node.high, x))


@dataclass
class BoostedTrees:
    """Log odds of the positive class: ``bias`` plus the trees."""

    bias: float
    trees: list[Node]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def expression(self, features: list[Column]) -> Column:
        def case(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(features[node.feature] <= F.lit(node.cut), case(node.low)).otherwise(case(node.high))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + case(tree)
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 12, depth: int = 3, rate: float = 0.4, ridge: float = 1.0, least: int = 5) -> BoostedTrees:
    """Logistic boosting. With one class only, the bias alone."""
    p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    model = BoostedTrees(float(np.log(p / (1 - p))), [])
    if len(np.unique(y)) < 2:
        return model
    f = np.full(len(y), model.bias)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        tree = _grow(x, y - q, q * (1 - q), np.arange(len(y)), depth, ridge, least)

        def shrink(node: Node) -> None:
            node.value *= rate
            for child in (node.low, node.high):
                if child:
                    shrink(child)

        shrink(tree)
        model.trees.append(tree)
        f += _apply(tree, x)
    return model
