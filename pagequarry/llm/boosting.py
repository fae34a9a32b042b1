"""Boosted trees over counted feature rows, compiled to a native expression.

Training data are *distinct* feature rows with their numbers of negative and
positive cases, so the fit sees every case of the corpus while the driver holds
at most the product of the feature cardinalities.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A split ``x[feature] <= value`` with two subtrees, or a leaf."""

    leaf: float = 0.0
    feature: str = ""
    value: int = 0
    low: Tree | None = None
    high: Tree | None = None


@dataclass
class Boosted:
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margins(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(rows.values())))
        return self.base + sum((_apply(t, rows) for t in self.trees), np.zeros(n))

    def column(self, of) -> Column:
        """Probability as a native expression; ``of(name)`` gives a feature's column."""
        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + _column(t, of)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _apply(t: Tree, rows: dict[str, np.ndarray]) -> np.ndarray:
    if not t.feature:
        return np.full(len(next(iter(rows.values()))), t.leaf)
    return np.where(rows[t.feature] <= t.value, _apply(t.low, rows), _apply(t.high, rows))


def _column(t: Tree, of) -> Column:
    if not t.feature:
        return F.lit(float(t.leaf))
    return F.when(of(t.feature) <= t.value, _column(t.low, of)).otherwise(_column(t.high, of))


def fit(rows: dict[str, np.ndarray], neg: np.ndarray, pos: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4, l2: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; ties in gain go to the first feature and value."""
    weight = neg + pos
    rate0 = (pos.sum() + 1.0) / (weight.sum() + 2.0)
    model = Boosted(float(np.log(rate0 / (1 - rate0))))
    margin = np.full(len(weight), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = pos - weight * p, weight * p * (1 - p)
        tree = _grow(rows, grad, hess, np.ones(len(weight), bool), depth, rate, l2)
        model.trees.append(tree)
        margin = margin + _apply(tree, rows)
    return model


def _grow(rows, grad, hess, inside, depth, rate, l2) -> Tree:
    g, h = grad[inside].sum(), hess[inside].sum()
    leaf = Tree(leaf=float(rate * g / (h + l2)))
    best = (1e-6, "", 0)
    for name, values in rows.items() if depth else ():
        for v in np.unique(values[inside])[:-1]:
            left = inside & (values <= v)
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
            if gain > best[0]:
                best = (gain, name, int(v))
    if not best[1]:
        return leaf
    left = inside & (rows[best[1]] <= best[2])
    return Tree(
        feature=best[1],
        value=best[2],
        low=_grow(rows, grad, hess, left, depth - 1, rate, l2),
        high=_grow(rows, grad, hess, inside & ~left, depth - 1, rate, l2),
    )
