"""Hybrid naive Bayes: Bernoulli on binary columns, Gaussian elsewhere; one aggregation to fit, one expression to predict."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import blocks
from orrery.operators.prep import Named, is_binary, never

CLASSES = (-1, 1)


def fit(train: DataFrame, features: list[str], mode: str = "hybrid", named: Named = never) -> dict:
    """Model of normalised rows (features, y); mode: hybrid, gaussian or bernoulli. Rows with a null feature take no part."""
    train = blocks.complete(train, features)
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}"), F.count_if(x > 0.5).alias(f"o{i}"), is_binary(f).alias(f"b{i}")]
    rows = {(1 if r["k"] else -1): r for r in train.groupBy((F.col("y") == 1).alias("k")).agg(*aggs).collect()}
    total = sum(r["n"] for r in rows.values())
    model: dict = {"prior": {c: (rows[c]["n"] + 1) / (total + 2) if c in rows else 1 / (total + 2) for c in CLASSES}, "features": {}}
    for i, f in enumerate(features):
        binary = {"gaussian": False, "bernoulli": True}.get(mode, named(f) or all(r[f"b{i}"] for r in rows.values()))
        terms = {}
        for c in CLASSES:
            n, r = (rows[c]["n"], rows[c]) if c in rows else (0, None)
            mean = r[f"s{i}"] / n if n else 0.0
            var = max(r[f"q{i}"] / n - mean * mean, 1e-9) if n else 1.0
            terms[c] = {"mean": mean, "var": var, "p_on": ((r[f"o{i}"] if n else 0) + 1) / (n + 2)}
        model["features"][f] = (binary, terms)
    return model


def score(model: dict, c: int) -> Column:
    out = F.lit(math.log(model["prior"][c]))
    for f, (binary, terms) in model["features"].items():
        x, t = F.col(f).cast("double"), terms[c]
        if binary:
            out = out + F.when(x > 0.5, math.log(t["p_on"])).otherwise(math.log(1 - t["p_on"]))
        else:
            out = out + (F.lit(-0.5 * math.log(2 * math.pi * t["var"])) - (x - t["mean"]) * (x - t["mean"]) * (0.5 / t["var"]))
    return out


def predict(rows: DataFrame, model: dict) -> DataFrame:
    """rows with pred: the likelier class, -1 if both are alike; null where a feature is null."""
    up, down = score(model, 1), score(model, -1)
    return rows.withColumn("pred", F.when(up > down, 1).when(up <= down, -1))


@dataclass(frozen=True)
class Params:
    mode: str = "hybrid"


@dataclass(frozen=True)
class Model:
    features: list[str]
    terms: dict

    def transform(self, rows: DataFrame) -> DataFrame:
        return predict(rows, self.terms)


def fit_model(train: DataFrame, features: list[str], params: Params = Params(), named: Named = never) -> Model:
    return Model(features, fit(train, features, params.mode, named))
