"""Rows packed into blocks of float32 matrices, for operators that work on numpy arrays inside tasks.

A block is one row: n, x (n * features float32, row by row) and y (n int8). Rows with a null or non-finite feature or a
null label are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 8192


def complete(df: DataFrame, features: list[str], label: str | None = "y") -> DataFrame:
    """Rows whose features (and label) all have a finite value."""
    if label:
        df = df.where(F.col(label).isNotNull())
    for f in features:
        x = F.col(f).cast("double")
        df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df


def matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    """The features of a batch as float32, a row each."""
    return np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1).astype(np.float32)


def packed(df: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = part.column(label).to_numpy(zero_copy_only=False).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([matrix(part, features).tobytes()]), pa.array([y.tobytes()])], names=["n", "x", "y"])

    return complete(df, features, label).select(*(F.col(f).cast("float").alias(f) for f in features), F.col(label).cast("int").alias(label)).mapInArrow(pack, "n long, x binary, y binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of every block."""
    for batch in batches:
        for n, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y"))):
            yield np.frombuffer(x, np.float32).reshape(n, -1), np.frombuffer(y, np.int8)


def summed(blocks: DataFrame, size: int, partial: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of partial(x, y), a vector of ``size`` numbers; each task adds up its own blocks first.

    What differs from call to call is inside ``partial`` alone, so Spark compiles the plan once.
    """

    def add(batches):
        total = np.zeros(size)
        for x, y in unpacked(batches):
            total += partial(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=[f"s{i}" for i in range(size)])

    row = blocks.mapInArrow(add, ", ".join(f"s{i} double" for i in range(size))).agg(*(F.sum(f"s{i}") for i in range(size))).first()
    return np.array([v or 0.0 for v in row])
