"""Preparation: binary columns, z-scores from the training rows, counts and summaries of columns.

A column is binary if its name says so or if the training rows hold 0 and 1 only; binary columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import ordering

Named = Callable[[str], bool]


def by_name(*names: str) -> Named:
    """Columns that are binary by their name: those given, and those that start with one that ends in "_"."""
    return lambda feature: any(feature == n or n.endswith("_") and feature.startswith(n) for n in names)


def never(feature: str) -> bool:
    return False


def is_binary(feature: str):
    """Aggregate: whether a column holds 0 and 1 only (true without rows)."""
    c = F.col(feature)
    return F.coalesce(F.bool_and((F.abs(c) < 1e-9) | (F.abs(c - 1) < 1e-9)), F.lit(True))


def column_stats(train: DataFrame, features: list[str], named: Named = never) -> dict[str, tuple[bool, float, float]]:
    """(binary, mean, sd) of each feature by one aggregation; mean 0 and sd 1 for binary columns, sd 1 below 1e-9."""
    aggs = [a for i, f in enumerate(features) for a in (is_binary(f).alias(f"b{i}"), F.avg(F.col(f).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(f).cast("double")).alias(f"s{i}"))]
    row = train.agg(*aggs).first()
    out = {}
    for i, f in enumerate(features):
        binary = named(f) or row[f"b{i}"]
        out[f] = (binary, 0.0, 1.0) if binary else (False, row[f"m{i}"], row[f"s{i}"] if row[f"s{i}"] >= 1e-9 else 1.0)
    return out


def normalised(df: DataFrame, stats: dict[str, tuple[bool, float, float]]) -> DataFrame:
    return df.withColumns({f: ((F.col(f).cast("double") - F.lit(m)) / F.lit(s)).cast("float") for f, (_, m, s) in stats.items()})


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot([], columns, "feature", "nulls")


def stats_frame(df: DataFrame, features: list[str], named: Named = never) -> DataFrame:
    """feature, is_binary, mean, sd as z-scoring uses them."""
    rows = [(f, *v) for f, v in column_stats(df, features, named).items()]
    return df.sparkSession.createDataFrame(rows, "feature string, is_binary boolean, mean double, sd double")


def dataset_info(df: DataFrame, features: list[str], stats: dict[str, tuple[bool, float, float]], split: str = "is_test", label: str = "y") -> DataFrame:
    """is_test, n_rows, n_features, n_positive, n_negative, n_scaled and n_passed (features) of both parts."""
    scaled = sum(not b for b, _, _ in stats.values())
    return df.groupBy(split).agg(
        F.count("*").alias("n_rows"), F.lit(len(features)).cast("long").alias("n_features"), F.count_if(F.col(label) == 1).alias("n_positive"),
        F.count_if(F.col(label) != 1).alias("n_negative"), F.lit(scaled).cast("long").alias("n_scaled"), F.lit(len(features) - scaled).cast("long").alias("n_passed"),
    )


def info(df: DataFrame) -> DataFrame:
    """place, column, type and non_null of every column."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).unpivot([], df.columns, "column", "non_null")
    types = df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "place int, column string, type string")
    return F.broadcast(types).join(counts, "column").select("place", "column", "type", "non_null")


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, count, mean, std (of the sample), min, q25, q50, q75, max; quartiles lie between the two nearest of the sorted values.

    Exact at any size: quartiles come from counts of distinct values in ranges, not from one task that holds a column.
    """
    counts = ordering.storage.written(ordering.value_counts(df, features), "values")
    aggs = [a for i, f in enumerate(features) for x in [F.col(f).cast("double")] for a in (F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}"))]
    row = df.agg(*aggs).first()
    spots = {f: {q: q * (row[f"n{i}"] - 1) for q in (0.25, 0.5, 0.75)} for i, f in enumerate(features) if row[f"n{i}"]}
    asked = {f: [p for at in qs.values() for p in (int(at), min(int(at) + 1, row[f"n{features.index(f)}"] - 1))] for f, qs in spots.items()}
    found = {(r["feature"], r["position"]): r["value"] for r in ordering.order_statistics(counts, asked).collect()} if asked else {}
    out = []
    for i, f in enumerate(features):
        quartiles = []
        for q in (0.25, 0.5, 0.75):
            if f in spots:
                at = spots[f][q]
                low, high = found[f, int(at)], found[f, min(int(at) + 1, row[f"n{i}"] - 1)]
                quartiles.append(low + (high - low) * (at - int(at)))
            else:
                quartiles.append(None)
        out.append((f, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"a{i}"], *quartiles, row[f"z{i}"]))
    return df.sparkSession.createDataFrame(out, "feature string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
