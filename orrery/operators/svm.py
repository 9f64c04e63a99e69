"""Linear SVM by full-batch sub-gradient descent: one job an epoch over packed blocks, gradients added up in the tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import blocks


@dataclass(frozen=True)
class Params:
    """epochs, learning rate and decay of the weights; negative values count as 0."""

    epochs: int = 20
    lr: float = 0.02
    decay: float = 1e-4

    def __post_init__(self):
        for name in ("epochs", "lr", "decay"):
            object.__setattr__(self, name, max(getattr(self, name), 0))


@dataclass(frozen=True)
class Model:
    features: list[str]
    weights: list[float]
    bias: float

    def transform(self, rows: DataFrame) -> DataFrame:
        return predict(rows, self.features, (self.weights, self.bias))


def decision(features: list[str], w: list[float], b: float) -> Column:
    out = F.lit(b)
    for f, x in zip(features, w):
        out = out + F.lit(x) * F.col(f).cast("double")
    return out


def gradient(w: np.ndarray, b: float):
    """Rows, sum of y and sums of y * x over the rows whose margin is below 1."""

    def partial(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = x.astype(np.float64), y.astype(np.float64)
        active = y * (x @ w + b) < 1
        return np.concatenate([[len(y), y[active].sum()], y[active] @ x[active]])

    return partial


def fit(train: DataFrame, features: list[str], epochs: int = 20, lr: float = 0.02, decay: float = 1e-4) -> tuple[list[float], float]:
    """(weights, bias); zero without rows, features, epochs or a learning rate. Rows with a null feature take no part."""
    w, b = np.zeros(len(features)), 0.0
    if epochs <= 0 or lr <= 0 or not features:
        return w.tolist(), b
    rows = blocks.packed(train, features).persist()
    try:
        for _ in range(epochs):
            n, up, *g = blocks.summed(rows, len(features) + 2, gradient(w, b))
            if not n:
                break
            w = (1 - lr * decay) * w + lr / n * np.array(g)
            b += lr / n * up
    finally:
        rows.unpersist()
    return w.tolist(), float(b)


def fit_model(train: DataFrame, features: list[str], params: Params = Params()) -> Model:
    return Model(features, *fit(train, features, params.epochs, params.lr, params.decay))


def predict(rows: DataFrame, features: list[str], model: tuple[list[float], float]) -> DataFrame:
    """rows with pred: 1 where the decision is 0 or above, else -1; null where a feature is null."""
    score = decision(features, *model)
    return rows.withColumn("pred", F.when(score >= 0, 1).when(score < 0, -1))
