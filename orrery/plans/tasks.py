"""Learning tasks on the tables: features, label y in {-1, +1} and the test split, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.prep import by_name

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
NUMERIC = {"f_qty": "l_quantity", "f_price": "l_extendedprice", "f_disc": "l_discount", "f_tax": "l_tax", "f_line": "l_linenumber"}
FLAGS = ["A", "N", "R"]
FEATURES = [*NUMERIC, *(f"flag_{v}" for v in FLAGS), "is_open"]
NAMED = by_name("flag_", "is_open")


def lineitem_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    flag = [(F.col("l_returnflag") == v).cast("float").alias(f"flag_{v}") for v in FLAGS]
    return t.select(
        *KEYS, *(F.col(c).cast("float").alias(f) for f, c in NUMERIC.items()), *flag,
        (F.col("l_linestatus") == "O").cast("float").alias("is_open"),
        F.when(paid > 50000, 1).otherwise(-1).alias("y"), (F.col("l_orderkey") % 5 == 0).alias("is_test"),
    )


_FLAG_SQL = ", ".join(f"CAST(l_returnflag = '{v}' AS FLOAT) AS \"flag_{v}\"" for v in FLAGS)
TASK_SQL = f"""t AS (SELECT {", ".join(KEYS)}, {", ".join(f"CAST({c} AS FLOAT) AS {f}" for f, c in NUMERIC.items())}, {_FLAG_SQL},
  CAST(l_linestatus = 'O' AS FLOAT) AS is_open,
  CASE WHEN l_extendedprice * (1 - l_discount) * (1 + l_tax) > 50000 THEN 1 ELSE -1 END AS y, l_orderkey % 5 = 0 AS is_test FROM lineitem)"""


def embedding_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features, y (1 for labels below 5), is_test (every fifth id)."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"), (F.col("vec_id") % 5 == 0).alias("is_test"))
