"""Global ranks and exact order statistics without one task that sees all rows.

Rows are dealt to ranges of the order and written with the number of their range; the counts of the ranges (as many as there
are partitions) give every range the rank of its first row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery import storage


def _ranges(df: DataFrame, order: list[str], per: list[str]) -> DataFrame:
    """df written in ranges of (per, order), with the range as column _range."""
    return storage.written(df.repartitionByRange(*per, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with its global row number from 1 in ascending order; ``order`` has to be unique for a defined result."""
    rows = _ranges(df, order, [])
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    first = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    # a row for each range: bounded by the number of partitions
    return rows.withColumn(name, local).join(F.broadcast(first), "_range").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, value (double), n for every distinct value that is neither null nor NaN; each batch is counted before rows are dealt."""

    def count(batches):
        for batch in batches:
            for i, f in enumerate(features):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                values, n = np.unique(x[~np.isnan(x)] + 0.0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(values), pa.string()), pa.array(values), pa.array(n)], names=["feature", "value", "n"])

    some = df.select(*(F.col(f).cast("double").alias(f) for f in features)).mapInArrow(count, "feature string, value double, n long")
    return some.groupBy("feature", "value").agg(F.sum("n").alias("n"))


def order_statistics(counts: DataFrame, positions: dict[str, list[int]]) -> DataFrame:
    """feature, position, value: the value at each position (from 0) of each feature's sorted rows, from value_counts.

    Every range of values knows how many rows come before it, so a feature's values are never sorted in one task.
    """
    rows = _ranges(counts, ["value"], ["feature"])
    sums = rows.groupBy("feature", "_range").agg(F.sum("n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    first = sums.select("feature", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    upto = F.sum("n").over(Window.partitionBy("feature", "_range").orderBy("value"))
    placed = rows.withColumn("_upto", upto).join(F.broadcast(first), ["feature", "_range"])
    asked = [(f, p) for f, ps in positions.items() for p in sorted(set(ps))]
    want = df_of(counts, asked)
    inside = (F.col("position") >= F.col("_before") + F.col("_upto") - F.col("n")) & (F.col("position") < F.col("_before") + F.col("_upto"))
    return placed.join(F.broadcast(want), "feature").where(inside).select("feature", "position", "value")


def df_of(like: DataFrame, asked: list[tuple[str, int]]) -> DataFrame:
    return like.sparkSession.createDataFrame(asked, "feature string, position long")


def shuffled(df: DataFrame, keys: list[str], seed: int, epoch: int = 0) -> Column:
    """The order key of a seeded shuffle: an MD5 digest of seed, epoch and the row's keys; the same on every run and cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *(F.col(k).cast("string") for k in keys)))


def split(df: DataFrame, keys: list[str], percent: int = 80, seed: int = 42, ties: list[str] | None = None) -> DataFrame:
    """df with is_train: the first floor(n * percent / 100) rows of a seeded shuffle; ``ties`` order rows of equal keys."""
    rows = ranked(df.withColumn("_order", shuffled(df, keys, seed)), ["_order", *(ties or keys)], "_rank")
    n = rows.count()
    return rows.withColumn("is_train", F.col("_rank") <= n * percent // 100).drop("_order", "_rank")


def minibatches(df: DataFrame, keys: list[str], *, seed: int = 42, epoch: int = 0, size: int = 128, ties: list[str] | None = None) -> DataFrame:
    """df with its batch (from 0) in the epoch's shuffle; the last rows that don't fill a batch are dropped."""
    rows = ranked(df.withColumn("_order", shuffled(df, keys, seed, epoch)), ["_order", *(ties or keys)], "_rank")
    n = rows.count()
    return rows.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("long")).where(F.col("batch") < n // size).drop("_order", "_rank")
