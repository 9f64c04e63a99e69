"""Encodings of categories, with the categories taken from the training rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More categories than that are no categories.
MOST = 1000


def categories(train: DataFrame, column: str) -> list:
    """The sorted distinct values of a column; raises above MOST."""
    found = [r[0] for r in train.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"{column} has more than {MOST} values")
    return sorted(found)


def one_hot(df: DataFrame, column: str, values: list, prefix: str | None = None) -> DataFrame:
    """df without the column, with a 0/1 column for each value at its end; nulls and values not known are 0 in all."""
    prefix = column if prefix is None else prefix
    return df.select(*(c for c in df.columns if c != column), *(F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values))


def label_encode(df: DataFrame, column: str, values: list, name: str | None = None) -> DataFrame:
    """df with the column's place among the sorted values, from 0; null for values not known."""
    code = F.array_position(F.array(*(F.lit(v) for v in values)), F.col(column)) if values else F.lit(0)
    return df.withColumn(name or column, F.when(code > 0, (code - 1).cast("int")))
