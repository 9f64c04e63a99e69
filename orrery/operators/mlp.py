"""Multilayer perceptron: features -> hidden -> hidden -> one logit, ReLU, cross-entropy, momentum.

Two ways to train: ``fit`` takes minibatches in a seeded order one after the other, as the model is defined, on one worker or on
several that share every step in a barrier stage. ``fit_full`` takes one step an epoch on the gradient of all rows, added up in
the tasks, for tables where steps of 128 rows make no sense. Both share weights, gradient and update.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery import storage
from orrery.functions import scalar
from orrery.operators import blocks, sequences

LAYERS = ("w1", "b1", "w2", "b2", "w3", "b3")


@dataclass(frozen=True)
class Params:
    epochs: int = 30
    lr: float = 0.01
    decay: float = 1e-4
    momentum: float = 0.9
    batch: int = 128
    hidden: tuple[int, int] = (64, 32)
    seed: int = 42
    workers: int = 1
    block: int = 512  # rows of a forward pass; no prediction depends on it beyond rounding

    def __post_init__(self):
        for name in ("batch", "workers", "block"):
            object.__setattr__(self, name, max(getattr(self, name), 1))
        for name in ("epochs", "lr", "decay"):
            object.__setattr__(self, name, max(getattr(self, name), 0))


Weights = dict[str, np.ndarray]


def initial(features: int, params: Params = Params()) -> Weights:
    """Normal weights of deviation sqrt(2 / inputs) in the hidden layers, uniform ones of +-0.01 in the last, biases 0."""
    a, b = params.hidden
    draw = np.random.default_rng(params.seed)
    return {
        "w1": draw.normal(0, np.sqrt(2 / max(features, 1)), (a, features)), "b1": np.zeros(a), "w2": draw.normal(0, np.sqrt(2 / a), (b, a)), "b2": np.zeros(b),
        "w3": draw.uniform(-0.01, 0.01, (1, b)), "b3": np.zeros(1),
    }


def forward(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Activations of both hidden layers and the logits."""
    first = np.maximum(x @ w["w1"].T + w["b1"], 0)
    second = np.maximum(first @ w["w2"].T + w["b2"], 0)
    return first, second, (second @ w["w3"].T + w["b3"])[:, 0]


def losses(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) - z * target + np.log1p(np.exp(-np.abs(z)))


def backward(w: Weights, x: np.ndarray, target: np.ndarray) -> tuple[float, Weights]:
    """Sum of the losses and of the gradients over rows."""
    first, second, z = forward(w, x)
    dz = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target)[:, None]
    d2 = (dz @ w["w3"]) * (second > 0)
    d1 = (d2 @ w["w2"]) * (first > 0)
    return float(losses(z, target).sum()), {"w1": d1.T @ x, "b1": d1.sum(axis=0), "w2": d2.T @ first, "b2": d2.sum(axis=0), "w3": dz.T @ second, "b3": dz.sum(axis=0)}


def update(w: Weights, speed: Weights, grad: Weights, rows: int, lr: float, params: Params) -> None:
    """One step with momentum; weights decay, biases don't."""
    for name in LAYERS:
        speed[name] = params.momentum * speed[name] + grad[name] / rows
        keep = 1 - lr * params.decay if name[0] == "w" else 1.0
        w[name] = keep * w[name] - lr * speed[name]


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in LAYERS])


def shaped(v: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for n in LAYERS:
        out[n] = v[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


@dataclass
class Model:
    features: list[str]
    weights: Weights
    epoch_loss: list[float]
    block: int = Params.block

    def transform(self, rows: DataFrame) -> DataFrame:
        z = logits(rows, self.features, self.weights, self.block)
        return z.withColumn("pred", F.when(F.col("logit") >= 0, 1).when(F.col("logit") < 0, -1))


def _epoch(told: sequences.Dealt, w: Weights, speed: Weights, epoch: int, batches: int, params: Params, worker: int, gather) -> tuple[float, int]:
    """Steps of one epoch on one worker; ``gather`` gives every worker's numbers in the order of workers. All end with equal weights."""
    total, n, lr, rows = 0.0, 0, scalar.decayed(params.lr, epoch), params.batch * params.workers
    own, (now, speeds) = np.zeros(1 + sum(v.size for v in w.values())), (flat(w), flat(speed))
    keep = np.concatenate([np.full(w[name].size, 1 - lr * params.decay if name[0] == "w" else 1.0) for name in LAYERS])
    w.update(shaped(now, w))  # all weights lie in one vector, so that a step (that of ``update``) takes them at once
    speed.update(shaped(speeds, speed))
    for x, y, ends in told.batches(worker, params.seed, epoch, params.batch, batches):
        loss, grad = backward(w, x.astype(np.float64), (y == 1).astype(float))
        own += np.concatenate([[loss], flat(grad)])
        if ends:
            every = sum(gather(own))
            speeds *= params.momentum
            speeds += every[1:] / rows
            now *= keep
            now -= lr * speeds
            total, n = total + every[0], n + rows
            own[:] = 0
    return float(total), n


def fit(train: DataFrame, features: list[str], keys: list[str], params: Params = Params(), weights: Weights | None = None, *, ties: list[str] | None = None, saved: str | None = None) -> Model:
    """Trained by minibatches in a seeded order; rows that don't fill a step are left out.

    Rows are dealt to ``workers`` once, ``batch`` rows to each in turn in the order of the seeded shuffle of ``keys``; after the
    first epoch each worker permutes its blocks and the rows in them. An epoch is one barrier stage: each worker adds up the
    gradient of its batch, all gather the others' and take the same step, on batch * workers rows. No row passes through the
    driver. A lost task restarts its epoch from the weights that it began with; with ``saved``, a folder, every epoch's
    state is written there, and a later call goes on from the last one. Nothing is trained without rows, features, epochs
    or a learning rate, or with less than a step.
    """
    w = {n: v.copy() for n, v in (weights or initial(len(features), params)).items()}
    model = Model(features, w, [], params.block)
    if not features or params.epochs <= 0 or params.lr <= 0:
        return model
    spark = train.sparkSession
    told = sequences.dealt(train, features, keys, params.workers, batch=params.batch, seed=params.seed, ties=ties)
    batches = told.rows // (params.batch * params.workers)
    speed = {n: np.zeros_like(v) for n, v in w.items()}
    for epoch in range(params.epochs if batches else 0):
        place = f"{saved}/epoch={epoch}" if saved else storage.shared_path(spark, f"perceptron-{epoch}")

        def run(rows, w=w, speed=speed, epoch=epoch):
            context = BarrierTaskContext.get()
            worker = context.partitionId()

            def gather(v: np.ndarray) -> list[np.ndarray]:
                if params.workers == 1:
                    return [v]
                return [np.frombuffer(base64.b64decode(s), np.float64) for s in context.allGather(base64.b64encode(v.tobytes()).decode())]

            for _ in rows:
                pass
            w, speed = dict(w), dict(speed)
            total, n = _epoch(told, w, speed, epoch, batches, params, worker, gather)
            if worker == 0:
                yield pa.RecordBatch.from_arrays([pa.array([total / n]), pa.array([flat(w).tolist()]), pa.array([flat(speed).tolist()])], names=["loss", "w", "speed"])

        schema = "loss double, w array<double>, speed array<double>"
        state = spark.read.schema(schema).parquet(place).first() if saved and _there(place) else None
        if state is None:
            spark.range(0, params.workers, 1, params.workers).mapInArrow(run, schema, barrier=True).write.mode("overwrite").parquet(place)
            state = spark.read.schema(schema).parquet(place).first()
        w, speed = shaped(np.array(state["w"]), w), shaped(np.array(state["speed"]), w)
        model.weights = w
        model.epoch_loss.append(state["loss"])
    return model


def _there(place: str) -> bool:
    fs, path = storage.open_fs(place)
    return fs.get_file_info(f"{path}/_SUCCESS").is_file


def fit_full(train: DataFrame, features: list[str], params: Params = Params(), weights: Weights | None = None) -> Model:
    """Trained by one step an epoch on the gradient of all rows."""
    w = weights or initial(len(features), params)
    model = Model(features, w, [], params.block)
    if not features or params.epochs <= 0 or params.lr <= 0:
        return model
    speed = {n: np.zeros_like(v) for n, v in w.items()}
    size = sum(v.size for v in w.values())
    rows = blocks.packed(train, features).persist()
    try:
        for epoch in range(params.epochs):
            now = dict(w)

            def partial(x, y, now=now):
                loss, grad = backward(now, x.astype(np.float64), (y == 1).astype(float))
                return np.concatenate([[len(y), loss], flat(grad)])

            n, loss, *grad = _summed_long(rows, size + 2, partial)
            if not n:
                break
            update(w, speed, shaped(np.array(grad), w), n, scalar.decayed(params.lr, epoch), params)
            model.epoch_loss.append(loss / n)
    finally:
        rows.unpersist()
    return model


def _summed_long(rows: DataFrame, size: int, partial) -> np.ndarray:
    """As blocks.summed, for vectors too long for a column each."""

    def add(batches):
        total = np.zeros(size)
        for x, y in blocks.unpacked(batches):
            total += partial(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many rows as weights
        out[r["i"]] = r["v"]
    return out


def logits(rows: DataFrame, features: list[str], w: Weights, block: int = Params.block) -> DataFrame:
    """rows with logit; null where a feature is null. Only the features go through numpy."""

    @F.arrow_udf(T.DoubleType())
    def judge(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.float32).astype(np.float64)
        z = np.concatenate([forward(w, np.nan_to_num(x[at : at + block]))[2] for at in range(0, len(x), block)] or [np.zeros(0)])
        return pa.array(z, mask=np.isnan(x).any(axis=1))

    return rows.withColumn("logit", judge(*(F.col(f).cast("float") for f in features)))
