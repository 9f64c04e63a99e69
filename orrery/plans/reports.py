"""Queries on benchmark and harness rows, made of the events table, and on result logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery import harness
from orrery.operators import benchmark
from orrery.plans.bayes_svm import _prepared
from orrery.plans.registry import registry
from orrery.plans.tasks import FEATURES, KEYS, NAMED
from orrery.sources import logs

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registry(QUERIES, ORACLE_SQL)

KINDS = {"view": "svm", "click": "knn", "error": "mlp", "purchase": "dt", "signup": "nb"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
_ROWS = f"""b AS (SELECT event_id AS seq, {_CASE} AS algorithm, ['serial', 'omp', 'pthreads'][event_id % 3 + 1] AS variant, CASE WHEN event_id % 3 = 0 THEN 1 ELSE CAST(1 << (user_id % 4) AS INTEGER) END AS n_threads,
  value AS train_ms, CAST(user_id % 50 AS DOUBLE) AS infer_ms, value + user_id % 50 AS total_ms, (user_id % 100) / 128.0::DOUBLE AS accuracy, (user_id % 64) / 64.0::DOUBLE AS "precision",
  (event_id % 64) / 64.0::DOUBLE AS recall, (event_id % 32) / 32.0::DOUBLE AS f1 FROM events)"""
_LIBRARY = """l AS (SELECT seq, algorithm, CASE WHEN algorithm = 'dt' AND seq % 2 = 0 THEN 'xgboost' ELSE 'sklearn' END AS framework, CASE WHEN algorithm = 'nb' AND seq % 4 < 2 THEN 'hybrid' ELSE 'default' END AS variant,
  CASE WHEN algorithm IN ('svm', 'nb') OR algorithm = 'dt' AND seq % 2 = 1 THEN 1 ELSE 8 END AS n_threads, train_ms, infer_ms, accuracy AS acc, "precision" AS prec, recall AS rec, f1, 'a, "note"' AS notes FROM b)"""


def bench_rows(spark, sf_dir) -> DataFrame:
    """seq (their order) and benchmark rows."""
    e, u = F.col("event_id"), F.col("user_id")
    name = F.lit(None).cast("string")
    for k, v in KINDS.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("seq"), name.alias("algorithm"), F.element_at(F.array(*map(F.lit, benchmark.VARIANTS)), (e % 3 + 1).cast("int")).alias("variant"),
        F.when(e % 3 == 0, 1).otherwise(F.pow(F.lit(2), u % 4).cast("int")).alias("n_threads"), F.col("value").alias("train_ms"), (u % 50).cast("double").alias("infer_ms"), (F.col("value") + u % 50).alias("total_ms"),
        ((u % 100) / 128).alias("accuracy"), ((u % 64) / 64).alias("precision"), ((e % 64) / 64).alias("recall"), ((e % 32) / 32).alias("f1"),
    )


def library_rows(spark, sf_dir) -> DataFrame:
    """seq and harness rows."""
    s, a = F.col("seq"), F.col("algorithm")
    return bench_rows(spark, sf_dir).select(
        "seq", "algorithm", F.when((a == "dt") & (s % 2 == 0), "xgboost").otherwise("sklearn").alias("framework"), F.when((a == "nb") & (s % 4 < 2), "hybrid").otherwise("default").alias("variant"),
        F.when(a.isin("svm", "nb") | (a == "dt") & (s % 2 == 1), 1).otherwise(8).alias("n_threads"), "train_ms", "infer_ms", F.col("accuracy").alias("acc"), F.col("precision").alias("prec"),
        F.col("recall").alias("rec"), "f1", F.lit('a, "note"').alias("notes"),
    )


_LAST = "last AS (SELECT algorithm, {} FROM b GROUP BY algorithm)".format(", ".join(f"max_by(total_ms, seq) FILTER (variant = '{v}') AS {v}_ms" for v in benchmark.VARIANTS))


@query(f"WITH {_ROWS}, {_LAST} SELECT algorithm, serial_ms, omp_ms, pthreads_ms, " + ", ".join(f"CASE WHEN serial_ms > 0 AND {v}_ms > 0 THEN round(serial_ms / {v}_ms, 6) END AS {v}_speedup" for v in ("omp", "pthreads")) + " FROM last")
def speedup_summary(spark, sf_dir):
    out = benchmark.speedups(bench_rows(spark, sf_dir), "seq")
    return out.withColumns({f"{v}_speedup": F.round(f"{v}_speedup", 6) for v in ("omp", "pthreads")})


@query(f"""WITH {_ROWS}, last AS (SELECT algorithm, variant, max_by(accuracy, seq) AS a FROM b GROUP BY ALL)
SELECT x.algorithm, x.variant, round(abs(x.a - s.a), 6) AS difference, abs(x.a - s.a) < 0.01 AS alike FROM last x JOIN last s ON x.algorithm = s.algorithm AND s.variant = 'serial' WHERE x.variant <> 'serial'""")
def parity_check(spark, sf_dir):
    return benchmark.parity(bench_rows(spark, sf_dir), "seq").withColumn("difference", F.round("difference", 6))


_CURVES = f"""{_ROWS}, base AS (SELECT algorithm, min_by(total_ms, seq) AS base FROM b WHERE variant = 'serial' GROUP BY algorithm),
curve AS (SELECT algorithm, variant, n_threads, min_by(total_ms, seq) AS total_ms FROM b WHERE variant <> 'serial' GROUP BY ALL)"""


@query(f"WITH {_CURVES} SELECT algorithm, variant, n_threads, total_ms, CASE WHEN base > 0 AND total_ms > 0 THEN round(base / total_ms, 6) END AS speedup FROM curve JOIN base USING (algorithm)")
def speedup_curves(spark, sf_dir):
    return benchmark.speedup_curves(bench_rows(spark, sf_dir), "seq").withColumn("speedup", F.round("speedup", 6))


@query(f"WITH {_CURVES} SELECT algorithm, variant, CASE WHEN base > 0 AND total_ms > 0 THEN round(base / total_ms, 6) END AS speedup FROM curve JOIN base USING (algorithm) WHERE n_threads = 8")
def speedup_bars(spark, sf_dir):
    out = benchmark.chosen(benchmark.speedup_curves(bench_rows(spark, sf_dir), "seq"), n_threads=8)
    return out.select("algorithm", "variant", F.round("speedup", 6).alias("speedup"))


@query(f"""WITH {_ROWS}, {_LIBRARY}, t AS (SELECT algorithm, framework, variant, n_threads, max_by(train_ms + infer_ms, seq) AS ms FROM l GROUP BY ALL),
o AS (SELECT algorithm, min_by(total_ms, seq) AS ours_ms FROM b WHERE variant = 'pthreads' AND n_threads = 8 GROUP BY algorithm)
SELECT o.algorithm, round(ours_ms, 6) AS ours_ms, round(p.ms, 6) AS library_ms, round(x.ms, 6) AS boosted_ms FROM o
LEFT JOIN t p ON p.algorithm = o.algorithm AND p.framework = 'sklearn' AND p.n_threads = CASE WHEN o.algorithm IN ('svm', 'dt', 'nb') THEN 1 ELSE 8 END AND p.variant = CASE WHEN o.algorithm = 'nb' THEN 'hybrid' ELSE 'default' END
LEFT JOIN t x ON x.algorithm = o.algorithm AND x.framework = 'xgboost' AND x.n_threads = 8 AND x.variant = 'default'""")
def cross_framework(spark, sf_dir):
    out = benchmark.cross_framework(bench_rows(spark, sf_dir), library_rows(spark, sf_dir), "seq")
    return out.select("algorithm", *(F.round(c, 6).alias(c) for c in ("ours_ms", "library_ms", "boosted_ms")))


@query(f"WITH {_ROWS}, {_LIBRARY} SELECT algorithm, framework, variant, n_threads, max_by(round(train_ms + infer_ms, 6), seq) AS total_ms FROM l GROUP BY ALL")
def framework_totals(spark, sf_dir):
    return benchmark.framework_total(library_rows(spark, sf_dir), "seq").withColumn("total_ms", F.round("total_ms", 6))


_HARNESS = "algorithm, framework, variant, n_threads, train_ms, infer_ms, acc, prec, rec, f1, notes"


@query(f"WITH {_ROWS}, {_LIBRARY} SELECT algorithm, 'ours' AS framework, variant, n_threads, train_ms, infer_ms, accuracy AS acc, \"precision\" AS prec, recall AS rec, f1, '' AS notes FROM b UNION ALL SELECT {_HARNESS} FROM l")
def combined_rows(spark, sf_dir):
    return benchmark.combined(bench_rows(spark, sf_dir).drop("seq"), library_rows(spark, sf_dir).drop("seq"))


@query(f"WITH {_ROWS}, {_LIBRARY} SELECT seq, train_ms, acc FROM l WHERE train_ms <= 0.05 OR acc > 0.75")
def insane_rows(spark, sf_dir):
    """Rows that the sanity check rejects once 0.05 ms is taken off the times and 0.25 added to the accuracy."""
    rows = library_rows(spark, sf_dir).withColumns({"train_ms": F.col("train_ms") - 0.05, "acc": F.col("acc") + 0.25})
    return benchmark.insane(rows).select("seq", F.round(F.col("train_ms") + 0.05, 6).alias("train_ms"), (F.col("acc") - 0.25).alias("acc"))


@query(f"WITH {_ROWS} SELECT algorithm, variant, min_by(total_ms, seq) AS first_ms, max_by(total_ms, seq) AS last_ms FROM b GROUP BY ALL")
def first_and_last_rows(spark, sf_dir):
    return bench_rows(spark, sf_dir).groupBy("algorithm", "variant").agg(F.min_by("total_ms", "seq").alias("first_ms"), F.max_by("total_ms", "seq").alias("last_ms"))


@query(f"WITH {_ROWS} SELECT seq, round(train_ms / 7, 2) AS train_ms, round(accuracy / 7, 4) AS accuracy FROM b")
def rounded_rows(spark, sf_dir):
    rows = bench_rows(spark, sf_dir).select("seq", (F.col("train_ms") / 7).alias("train_ms"), (F.col("accuracy") / 7).alias("accuracy"))
    return benchmark.rounded(rows)


def log_lines(spark, sf_dir) -> DataFrame:
    """The result blocks of all rows as logs (file, line, text): each followed by a summary that isn't part of it; the rows whose
    seq is divisible by 7 have no F1 line, and a tag of an unknown algorithm stands behind every block."""
    rows = benchmark.result_block(bench_rows(spark, sf_dir).withColumn("recall", F.round("recall", 4)))
    block = F.when(F.col("seq") % 7 == 0, F.regexp_replace("block", "  F1 Score[^\n]*\n", "")).otherwise(F.col("block"))
    rest = F.lit("\nSpeedup Summary\n  Accuracy parity check : 0.0001\n[Serial XYZ]\n  Accuracy       : 0.5\n")
    text = F.split(F.concat(block, rest), "\n")
    return rows.select(F.concat(F.lit("log"), F.col("seq") % 16).alias("file"), F.posexplode(text).alias("at", "text"), "seq").select("file", (F.col("seq") * 32 + F.col("at")).alias("line"), "text")


_F1 = "CASE WHEN seq % 7 = 0 THEN 0 ELSE round(f1, 4) END AS f1"
_TIMES = "train_ms, infer_ms"


@query(f"WITH {_ROWS} SELECT CAST(seq * 32 AS BIGINT) AS block, algorithm, variant, n_threads, round(total_ms, 2) AS total_ms, {_TIMES}, {_F1} FROM b")
def log_blocks(spark, sf_dir):
    return logs.parse_strict(log_lines(spark, sf_dir)).select("block", "algorithm", "variant", "n_threads", "total_ms", "train_ms", "infer_ms", "f1")


@query(f"WITH {_ROWS}, k AS (SELECT seq, algorithm, variant, n_threads, {_TIMES}, 0.5::DOUBLE AS never, {_F1} FROM b) SELECT CAST(seq * 32 AS BIGINT) AS block, algorithm, 'ours' AS framework, variant, n_threads, {_TIMES}, f1 FROM k UNION ALL SELECT CAST(seq * 32 + CASE WHEN seq % 7 = 0 THEN 11 ELSE 12 END - 1 AS BIGINT), 'xyz', 'ours', 'serial', 1, 0, 0, 0 FROM k")
def log_blocks_loose(spark, sf_dir):
    return logs.parse_loose(log_lines(spark, sf_dir)).select("block", "algorithm", "framework", "variant", "n_threads", "train_ms", "infer_ms", "f1")


_TAG = "CASE variant WHEN 'serial' THEN '[Serial ' || upper(algorithm) || ']' WHEN 'omp' THEN '[Parallel ' || upper(algorithm) || ' (OpenMP, ' || n_threads || ' threads)]' ELSE '[Parallel ' || upper(algorithm) || ' (pthreads, ' || n_threads || ' threads)]' END"


@query(f"WITH {_ROWS} SELECT seq, {_TAG} || chr(10) || printf('  Training time  : %.2f ms', train_ms) || chr(10) || printf('  Inference time : %.2f ms', infer_ms) AS head FROM b")
def result_blocks(spark, sf_dir):
    out = benchmark.result_block(bench_rows(spark, sf_dir))
    return out.select("seq", F.substring_index("block", "\n", 3).alias("head"))


@query(None)
def baseline_rows(spark, sf_dir):
    """Harness rows of the other models on the line-item task, past the sanity check."""
    train, test = (p.persist() for p in _prepared(spark, sf_dir))
    try:
        return benchmark.checked(harness.rows_frame(spark, harness.run(harness.library_jobs(FEATURES, KEYS, NAMED, epochs=2), train, test, spark.sparkContext.defaultParallelism)))
    finally:
        train.unpersist()
        test.unpersist()


@query(None)
def own_rows(spark, sf_dir):
    """Harness rows of the engine's own estimators on the line-item task, past the sanity check."""
    train, test = (p.persist() for p in _prepared(spark, sf_dir))
    try:
        return benchmark.checked(harness.rows_frame(spark, harness.run(harness.own_jobs(FEATURES, KEYS, NAMED), train, test, spark.sparkContext.defaultParallelism)))
    finally:
        train.unpersist()
        test.unpersist()
