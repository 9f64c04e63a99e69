"""CSV and JSON tables: typed scans, header scans, and the sinks of rows and reports."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators import benchmark

#: Where a file may lie, in the order in which the places are tried.
PLACES = ["", "../", "data/", "../data/", "../../data/", "../../../data/"]


def resolved(path: str, places: list[str] = PLACES) -> str:
    """The first place + path that exists on the driver, else the path itself; URIs stay as they are."""
    if "://" in path or path.startswith("file:"):
        return path
    return next((p + path for p in places if os.path.exists(p + path)), path)


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line; reads no other line."""
    first = spark.read.text(path).limit(1).first()
    if first is None or not first[0].strip():
        raise ValueError(f"{path} has no header")
    return next(csv.reader([first[0]]))


def schema_of(spark: SparkSession, path: str, label: str) -> T.StructType:
    """float features in the order of the header, then the label as int."""
    names = header(spark, path)
    if label not in names:
        raise ValueError(f"{path} has no column {label}")
    return T.StructType([*(T.StructField(n, T.FloatType()) for n in names if n != label), T.StructField(label, T.IntegerType())])


def read_matrix(spark: SparkSession, path: str, label: str, *, default: float | None = None) -> DataFrame:
    """Typed rows of a CSV file: float features and an int label.

    The first line of each file is its header, whatever it holds, quoted or behind a byte order mark; blank lines are skipped.
    A line with another number of fields than the header raises, and so does a field that is no number, unless a default
    stands in for it.
    """
    names, schema = header(spark, path), schema_of(spark, path, label)
    raw = T.StructType([*(T.StructField(f"f{i}", T.StringType()) for i in range(len(names))), T.StructField("_line", T.StringType())])
    # without pruning every field of a line is looked at, so its width is checked whatever is selected
    lines = spark.read.schema(raw).option("header", True).option("enforceSchema", True).option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    lines = lines.withColumn("_file", F.col("_metadata.file_path"))
    told = lambda what, column: F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(column, F.lit("")), F.lit(" in "), F.col("_file")))

    def number(name: str, kind: T.DataType) -> F.Column:
        field = F.col(f"f{names.index(name)}")
        value = F.trim(field).try_cast("double")
        value = F.coalesce(value, told(f"no number in column {name}", field) if default is None else F.lit(float(default)))
        return F.when(F.col("_line").isNotNull(), told(f"expected {len(names)} fields", F.col("_line"))).otherwise(value).cast(kind).alias(name)

    return lines.select(*(number(f.name, f.dataType) for f in schema.fields))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header and quoting, its types inferred where no schema is given."""
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.schema(schema).option("mode", "FAILFAST").csv(path) if schema else reader.option("inferSchema", True).csv(path)


def sweep_pair(spark: SparkSession, ours: str, library: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark rows and harness rows of a sweep."""
    return read_csv(spark, ours, benchmark.BENCHMARK), read_csv(spark, library, benchmark.HARNESS)


def write_csv(df: DataFrame, path: str, *, append: bool = False) -> None:
    """A folder of CSV files, each with a header."""
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def write_benchmark(rows: DataFrame, path: str) -> None:
    """Benchmark rows, times with 2 places and metrics with 4."""
    places = {c: 2 if c.endswith("_ms") else 4 for c in rows.columns if c.endswith("_ms") or c in ("accuracy", "precision", "recall", "f1")}
    write_csv(rows.withColumns({c: F.format_string(f"%.{n}f", c) for c, n in places.items()}), path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Harness rows added to those at path, which may not exist yet."""
    write_csv(rows, path, append=True)


def extend_json(rows: list[dict], path: str) -> int:
    """Adds rows to a JSON list in a local file of a report and returns its length; a missing file, or one that holds no list,
    counts as empty. The new file replaces the old one at once."""
    try:
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
    except (FileNotFoundError, ValueError):
        known = []
    known = known if isinstance(known, list) else []
    known += rows
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(known, f, indent=2)
    os.replace(f"{path}.new", path)
    return len(known)


def union_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rows of several CSV tables of one schema."""
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(paths)
