"""Boosted histogram trees for two classes: logistic loss, second-order gains and leaf weights.

A row has the first and second derivative of its loss at its margin; a node's gain and a leaf's weight follow from their sums,
regularised. Margins are found again in the tasks from the trees so far, so nothing is kept a row. All rows start with the same
margin and thus the same second derivative, so the edges that it weighs are those of the plain rows; they serve all rounds. Rows
go left where value < edge.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import blocks, tree


@dataclass(frozen=True)
class Params:
    """rounds, max_depth (at least 1), learning rate, regularisation of weights, least second derivative of a side, least gain, bins."""

    rounds: int = 1
    max_depth: int = 12
    lr: float = 1.0
    reg: float = 0.0
    min_child: float = 1.0
    min_gain: float = 1e-6
    bins: int = 64

    def __post_init__(self):
        object.__setattr__(self, "max_depth", max(self.max_depth, 1))
        if not 2 <= self.bins <= 256 or self.lr < 0 or self.reg < 0:
            raise ValueError("bins have to be 2 to 256, the rate and the regularisation not negative")


@dataclass
class Model:
    features: list[str]
    trees: list[list[tree.Node]] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)

    def margin(self) -> Column:
        """The sum of the leaves' weights; null where a feature is null."""
        out = F.lit(0.0)
        for nodes, w in zip(self.trees, self.weights):
            out = out + tree.of_leaves(nodes, self.features, w, "double")
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("margin", self.margin())
        return rows.withColumn("pred", F.when(F.col("margin") > 0, 1).when(F.col("margin") <= 0, -1))


def derivatives(trees: list[list[tree.Node]], weights: list[list[float]]) -> tree.Pair:
    """First and second derivative of each row's loss under the trees so far."""

    def pair(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = np.zeros(len(x))
        for nodes, w in zip(trees, weights):
            margin += np.array(w)[tree.walk(x, nodes)]
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return p - (y == 1), p * (1 - p)

    return pair


def gains_of(params: Params):
    """The gain of a split behind each bin (NaN: a side has too little) from sums of derivatives (features, bins)."""

    def gains(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        g, h = first.cumsum(axis=1), second.cumsum(axis=1)
        all_g, all_h = g[:, -1:], h[:, -1:]
        good = (h >= params.min_child) & (all_h - h >= params.min_child)
        score = lambda g, h: np.divide(g * g, h + params.reg, out=np.zeros(np.broadcast(g, h).shape), where=h + params.reg > 0)
        return np.where(good, score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h), np.nan)

    return gains


def fit(train: DataFrame, features: list[str], params: Params = Params()) -> Model:
    """Trees of complete rows (features float, y); without rows, features or rounds every margin is 0."""
    model = Model(features)
    packed = blocks.packed(train, features).persist()
    try:
        edges = tree.bin_edges(packed, features, params.bins)
        rows = tree.binned(packed, features, edges).persist()
        try:
            for _ in range(params.rounds):
                nodes = tree.grown(rows, features, edges, params, gains_of(params), derivatives(list(model.trees), list(model.weights)), strict=True)
                model.trees.append(nodes)
                model.weights.append([-params.lr * n.pos / (n.neg + params.reg) if n.neg + params.reg > 0 else 0.0 for n in nodes])
        finally:
            rows.unpersist()
    finally:
        packed.unpersist()
    return model
