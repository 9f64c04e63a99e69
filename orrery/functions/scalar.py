"""Scalar functions of the models and readers, as columns that stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays; null where a component is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: str | Column) -> Column:
    return dot(a, a)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    """||a||^2 + ||b||^2 - 2 a.b."""
    return squared_norm(a) + squared_norm(b) - 2 * dot(a, b)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def bce(z: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit, without overflow."""
    return F.greatest(z, F.lit(0.0)) - z * target + F.log1p(F.exp(-F.abs(z)))


def relu(z: Column, bias: float = 0.0) -> Column:
    return F.greatest(z + F.lit(bias), F.lit(0.0))


def gini(pos: Column, neg: Column) -> Column:
    """1 - p^2 - q^2 of two counts; 0 without rows."""
    n = (pos + neg).cast("double")
    return F.when(n > 0, 1 - (pos / n) * (pos / n) - (neg / n) * (neg / n)).otherwise(0.0)


def bin_of(x: Column, edges: list[float]) -> Column:
    """How many edges are at most x, at most all of them."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= x)) if edges else F.lit(0)


def decayed(rate: float, epoch: int) -> float:
    """The rate of an epoch (from 0): rate / sqrt(epoch + 1)."""
    return rate / math.sqrt(epoch + 1)


def remapped(y: Column) -> Column:
    """Labels -1 and 1 as 0 and 1; every other value is the negative class."""
    return F.when(y == 1, 1).otherwise(0)


def signed(t: Column) -> Column:
    """Labels 0 and 1 as -1 and 1."""
    return F.when(t == 1, 1).otherwise(-1)


def mapped(c: Column, values: dict) -> Column:
    """The value that a dictionary has for c; null for others."""
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def lenient_number(text: Column, default: float = 0.0) -> Column:
    """The number in a text without surrounding white space, or the default."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(float(default)))


def number_after_colon(line: Column, default: float = 0.0) -> Column:
    """The number that a line begins with after its first colon, or the default."""
    found = F.regexp_extract(line, r"^[^:]*:\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(float(default)))


def fields(line: Column, separator: str = ",") -> Column:
    """The parts of a line between separators, empty ones too; without quoting."""
    return F.split(line, f"\\Q{separator}\\E", -1)


def milliseconds(c: Column) -> Column:
    return F.round(c, 2)


def metric(c: Column) -> Column:
    return F.round(c, 4)


def total_ms(train: Column, infer: Column) -> Column:
    return train + infer
