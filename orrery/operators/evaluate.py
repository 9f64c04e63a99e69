"""Confusion counts and the metrics made of them; 0 where a denominator is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)


def metrics(rows: DataFrame) -> DataFrame:
    """tp, fp, tn, fn, accuracy, prec, recall, f1 of rows (y, pred); rows without a prediction aren't counted."""
    y, p = F.col("y"), F.col("pred")
    c = rows.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == -1) & (p == 1)).alias("fp"), F.count_if((y == -1) & (p == -1)).alias("tn"), F.count_if((y == 1) & (p == -1)).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    return c.select("*", _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("prec"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


METRICS_SQL = """SELECT tp, fp, tn, fn, CASE WHEN tp + fp + tn + fn > 0 THEN round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) ELSE 0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 6) ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 6) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) ELSE 0 END AS f1
FROM (SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = -1 AND pred = 1) AS fp, count(*) FILTER (y = -1 AND pred = -1) AS tn, count(*) FILTER (y = 1 AND pred = -1) AS fn FROM p)"""
