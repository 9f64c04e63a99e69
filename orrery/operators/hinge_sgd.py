"""Linear SVM by one step a row: sequential passes inside partitions, whose weights are mixed between epochs.

Rows are dealt to ``parts`` tables once, in a seeded order; an epoch is one job in which each task runs through its rows in a
seeded permutation (of its blocks, then of the rows in a block), starting from the mixed weights, and returns its own. The
mixture weighs each part by its rows. With one part that is plain stochastic descent, for which a single task reads all
rows, block by block; with more it's iterative parameter mixing, so it scales with the parts, and parts and seed define the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import sequences, svm


@dataclass(frozen=True)
class Params:
    """epochs, constant rate, decay of the weights, parts (at least 1), seed."""

    epochs: int = 20
    lr: float = 0.02
    decay: float = 1e-4
    parts: int = 1
    seed: int = 42

    def __post_init__(self):
        for name in ("epochs", "lr", "decay"):
            object.__setattr__(self, name, max(getattr(self, name), 0))
        object.__setattr__(self, "parts", max(self.parts, 1))


#: Most rows whose margins are found together.
AHEAD = 256


def steps(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, params: Params) -> tuple[np.ndarray, float]:
    """Weights and bias after a step for each row: weights decay, then a row whose margin was below 1 pulls.

    Up to the next row that pulls, weights only decay, so the margins of all rows until there are found together; how many rows
    are tried at once follows from the last gap between rows that pull.
    """
    keep, y = 1 - params.lr * params.decay, y.astype(np.float64)
    z, powers = y[:, None] * x.astype(np.float64), np.cumprod(np.concatenate([[1.0], np.full(AHEAD, keep)]))
    pulled = params.lr * z
    at, ahead, w = 0, 1, w.copy()
    while at < len(z):
        if ahead < 4:
            gap, pulls = 1, z[at] @ w + y[at] * b < 1
        else:
            near = z[at : at + ahead]
            below = (near @ w) * powers[: len(near)] + y[at : at + ahead] * b < 1
            gap = int(below.argmax()) + 1
            pulls = below[gap - 1]
            gap = gap if pulls else len(near)
        w *= powers[gap]
        at += gap
        ahead = min(2 * (gap if pulls else ahead), AHEAD)
        if pulls:
            w += pulled[at - 1]
            b += params.lr * y[at - 1]
    return w, b


def fit(train: DataFrame, features: list[str], keys: list[str], params: Params = Params()) -> svm.Model:
    """The model of complete rows (features, y in -1 and 1); keys identify a row. Zero without rows, features, epochs or a rate."""
    w, b = np.zeros(len(features)), 0.0
    if not features or params.epochs <= 0 or params.lr <= 0:
        return svm.Model(features, w.tolist(), b)
    told = sequences.dealt(train, features, keys, params.parts, seed=params.seed)
    spark = train.sparkSession
    for epoch in range(params.epochs):

        def run(batches, w=w, b=b, epoch=epoch):
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    rows, now = 0, (w, b)
                    for x, y in told.blocks(part, params.seed, epoch):
                        now, rows = steps(x, y, *now, params), rows + len(x)
                    yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([[*now[0].tolist(), float(now[1])]])], names=["rows", "model"])

        # a row a part
        found = spark.range(0, params.parts, 1, params.parts).mapInArrow(run, "rows long, model array<double>").where(F.col("rows") > 0).collect()
        n = sum(r["rows"] for r in found)
        if not n:
            break
        mixed = sum(np.array(r["model"]) * (r["rows"] / n) for r in sorted(found, key=lambda r: (r["rows"], r["model"])))
        w, b = mixed[:-1], float(mixed[-1])
    return svm.Model(features, w.tolist(), b)
