"""Tables about benchmark rows (algorithm, variant, n_threads, train_ms, infer_ms, total_ms, accuracy, precision, recall, f1) and
harness rows (algorithm, framework, variant, n_threads, train_ms, infer_ms, acc, prec, rec, f1, notes).

Where rows repeat, ``order`` says which one comes last; ties of it aren't defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALGORITHMS = ["svm", "knn", "mlp", "dt", "nb"]
VARIANTS = ["serial", "omp", "pthreads"]
THREADS = [1, 2, 4, 8]
BENCHMARK = "algorithm string, variant string, n_threads int, train_ms double, infer_ms double, total_ms double, accuracy double, precision double, recall double, f1 double"
HARNESS = "algorithm string, framework string, variant string, n_threads int, train_ms double, infer_ms double, acc double, prec double, rec double, f1 double, notes string"


def ratio(a: Column, b: Column) -> Column:
    """a / b where both are above 0, else null."""
    return F.when((a > 0) & (b > 0), a / b)


def rounded(rows: DataFrame) -> DataFrame:
    """Times at 2 places, metrics at 4."""
    times = {c: F.round(c, 2) for c in rows.columns if c.endswith("_ms")}
    return rows.withColumns(times | {c: F.round(c, 4) for c in rows.columns if c in ("accuracy", "precision", "recall", "acc", "prec", "rec", "f1")})


def known(rows: DataFrame) -> DataFrame:
    """Rows of a known algorithm."""
    return rows.where(F.col("algorithm").isin(ALGORITHMS))


def chosen(rows: DataFrame, **values) -> DataFrame:
    """Rows that have the given values."""
    for column, value in values.items():
        rows = rows.where(F.col(column) == value)
    return rows


def insane(rows: DataFrame) -> DataFrame:
    """Harness rows with a metric that is null or not finite, no positive training time, or an accuracy outside 0 to 1."""
    bad = F.lit(False)
    for c in ("train_ms", "infer_ms", "acc", "prec", "rec", "f1"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return rows.where(bad | (F.col("train_ms") <= 0) | ~F.col("acc").between(0, 1))


def checked(rows: DataFrame) -> DataFrame:
    """rows as they are; raises if any is insane."""
    first = insane(rows).first()
    if first is not None:
        raise ValueError(f"a row fails the sanity check: {first}")
    return rows


def speedups(rows: DataFrame, order: str) -> DataFrame:
    """algorithm, serial_ms, omp_ms, pthreads_ms, omp_speedup, pthreads_speedup; the last row of each counts, null where there is
    none or a time isn't positive."""
    last = rows.where(F.col("variant").isin(VARIANTS)).groupBy("algorithm").pivot("variant", VARIANTS).agg(F.max_by("total_ms", order))
    serial = F.col("serial")
    return last.select("algorithm", *(F.col(v).alias(f"{v}_ms") for v in VARIANTS), *(ratio(serial, F.col(v)).alias(f"{v}_speedup") for v in VARIANTS[1:]))


def parity(rows: DataFrame, order: str) -> DataFrame:
    """algorithm, variant, difference of its accuracy from the serial one's, alike (below 0.01)."""
    last = rows.groupBy("algorithm", "variant").agg(F.max_by("accuracy", order).alias("accuracy"))
    serial = last.where("variant = 'serial'").select("algorithm", F.col("accuracy").alias("base"))
    far = F.abs(F.col("accuracy") - F.col("base"))
    return last.where("variant <> 'serial'").join(F.broadcast(serial), "algorithm").select("algorithm", "variant", far.alias("difference"), (far < 0.01).alias("alike"))


def speedup_curves(rows: DataFrame, order: str) -> DataFrame:
    """algorithm, variant, n_threads, total_ms, speedup against the first serial row; the first row of each counts."""
    first = rows.groupBy("algorithm", "variant", "n_threads").agg(F.min_by("total_ms", order).alias("total_ms"))
    base = rows.where("variant = 'serial'").groupBy("algorithm").agg(F.min_by("total_ms", order).alias("base"))
    return first.where("variant <> 'serial'").join(F.broadcast(base), "algorithm").select("algorithm", "variant", "n_threads", "total_ms", ratio(F.col("base"), F.col("total_ms")).alias("speedup"))


def framework_total(rows: DataFrame, order: str) -> DataFrame:
    """algorithm, framework, variant, n_threads, total_ms (training and inference) of the last row of each."""
    total = (F.col("train_ms") + F.col("infer_ms")).alias("total_ms")
    return rows.groupBy("algorithm", "framework", "variant", "n_threads").agg(F.max_by(total, order).alias("total_ms"))


def cross_framework(ours: DataFrame, library: DataFrame, order: str) -> DataFrame:
    """algorithm, ours_ms (pthreads, 8 threads), library_ms and boosted_ms (null where there is none).

    The library's row is that of 1 thread for svm, dt and nb and of 8 for the others, of the hybrid variant for nb.
    """
    totals = framework_total(library, order)
    threads = F.when(F.col("algorithm").isin("svm", "dt", "nb"), 1).otherwise(8)
    variant = F.when(F.col("algorithm") == "nb", "hybrid").otherwise("default")
    plain = totals.where((F.col("framework") == "sklearn") & (F.col("n_threads") == threads) & (F.col("variant") == variant)).select("algorithm", F.col("total_ms").alias("library_ms"))
    boosted = totals.where("framework = 'xgboost' and n_threads = 8 and variant = 'default'").select("algorithm", F.col("total_ms").alias("boosted_ms"))
    own = ours.where("variant = 'pthreads' and n_threads = 8").groupBy("algorithm").agg(F.min_by("total_ms", order).alias("ours_ms"))
    return own.join(F.broadcast(plain), "algorithm", "left").join(F.broadcast(boosted), "algorithm", "left")


def combined(ours: DataFrame, library: DataFrame) -> DataFrame:
    """Benchmark rows and harness rows as harness rows."""
    renamed = ours.withColumnsRenamed({"accuracy": "acc", "precision": "prec", "recall": "rec"}).drop("total_ms")
    named = renamed.withColumns({"framework": F.lit("ours"), "notes": F.lit("")})
    columns = [c.split()[0] for c in HARNESS.split(", ")]
    return named.select(*columns).unionByName(library.select(*columns))


def result_block(rows: DataFrame) -> DataFrame:
    """rows with block: the text that reports one benchmark row under its tag."""
    name = F.upper("algorithm")
    engine = F.when(F.col("variant") == "omp", "OpenMP").otherwise("pthreads")
    tag = F.when(F.col("variant") == "serial", F.format_string("[Serial %s]", name)).otherwise(F.format_string("[Parallel %s (%s, %d threads)]", name, engine, "n_threads"))
    text = "  Training time  : %.2f ms\n  Inference time : %.2f ms\n  Total time     : %.2f ms\n  Accuracy       : %.4f\n  Precision      : %.4f\n  Recall         : %.4f\n  F1 Score       : %.4f\n"
    return rows.withColumn("block", F.concat(tag, F.lit("\n"), F.format_string(text, "train_ms", "infer_ms", "total_ms", "accuracy", "precision", "recall", "f1")))
