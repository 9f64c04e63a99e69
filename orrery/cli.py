"""Command line: python -m orrery ALGORITHM TRAIN TEST [...], or compare, ingest and sweep.

svm TRAIN TEST [EPOCHS] [LR] [DECAY] | knn TRAIN TEST [K] | mlp TRAIN TEST [EPOCHS] [LR] [DECAY] | dt TRAIN TEST [DEPTH] |
nb TRAIN TEST | analytics [TRAIN] [TEST] [OUT] | compare --train --test --out-csv --out-json | ingest LOG... --append --json.
N_THREADS sets the local cores. A parameter that is no number is its default.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import harness, storage
from orrery.operators import benchmark, evaluate, knn, mlp, naive_bayes, prep, svm, tree
from orrery.sources import logs, tables

LABEL = "round_winner"
#: Columns of such files that are binary by name.
NAMED = prep.by_name("map_", "bomb_planted")


def number(values: list[str], place: int, default, kind=float):
    """The place-th value as a number, or the default where it is missing or no number."""
    try:
        return kind(values[place])
    except (IndexError, ValueError):
        return default


def params_of(algorithm: str, values: list[str]):
    """The parameters of an algorithm from its arguments and the environment (block sizes), with their defaults and bounds."""
    if algorithm == "svm":
        return svm.Params(number(values, 0, 20, int), number(values, 1, 0.02), number(values, 2, 1e-4))
    if algorithm == "mlp":
        return mlp.Params(number(values, 0, 30, int), number(values, 1, 0.01), number(values, 2, 1e-4), block=harness.block_of("MLP_BLAS_BLOCK", mlp.Params.block))
    if algorithm == "knn":
        return knn.Params(number(values, 0, 11, int), harness.block_of("KNN_BLAS_BLOCK", knn.Params.block))
    if algorithm == "dt":
        return tree.Params(number(values, 0, 12, int))
    return naive_bayes.Params()


def session(algorithm: str = "") -> SparkSession:
    """A session whose workers keep to the algorithm's threads."""
    n = harness.threads_of()
    budget = harness.thread_budget(algorithm, n)
    os.environ.update(budget)  # for local workers
    return SparkSession.builder.config(map={f"spark.executorEnv.{k}": v for k, v in budget.items()}).appName("orrery").config("spark.sql.shuffle.partitions", str(4 * n)).config("spark.ui.enabled", "false").master(os.environ.get("SPARK_MASTER", f"local[{n}]")).getOrCreate()


def load(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Normalised training and test rows (id, features, y) of two CSV files, and the features."""
    parts = [tables.read_matrix(spark, tables.resolved(p), LABEL).withColumnRenamed(LABEL, "y").withColumn("id", F.monotonically_increasing_id()) for p in (train, test)]
    features = [c for c in parts[0].columns if c not in ("y", "id")]
    stats = prep.column_stats(parts[0], features, NAMED)
    prep.dataset_info(parts[0].withColumn("is_test", F.lit(False)).unionByName(parts[1].withColumn("is_test", F.lit(True))), features, stats).show()
    return (*(prep.normalised(p, stats) for p in parts), features)


def fitted(algorithm: str, train: DataFrame, features: list[str], params):
    if algorithm == "svm":
        return svm.fit_model(train, features, params)
    if algorithm == "mlp":
        return mlp.fit(train, features, ["id"], params)
    if algorithm == "dt":
        return tree.fit(train, features, params)
    if algorithm == "nb":
        return naive_bayes.fit_model(train, features, params, NAMED)
    return harness.WideNeighbours(train, features, params)


def job(algorithm: str, features: list[str], params) -> harness.Job:
    return harness.Job(algorithm, "ours", "hybrid" if algorithm == "nb" else "spark", lambda t: fitted(algorithm, t, features, params))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orrery")
    kinds = parser.add_subparsers(dest="kind", required=True)
    for name in benchmark.ALGORITHMS:
        sub = kinds.add_parser(name)
        sub.add_argument("train")
        sub.add_argument("test")
        sub.add_argument("values", nargs="*")
    sub = kinds.add_parser("analytics")
    for name, default in (("train", "train_cleaned.csv"), ("test", "test_cleaned.csv"), ("out", "analytics_results.csv")):
        sub.add_argument(name, nargs="?", default=default)
    sub = kinds.add_parser("compare")
    for name, default in (("--train", "train_cleaned.csv"), ("--test", "test_cleaned.csv"), ("--out-csv", "results.csv"), ("--out-json", "results.json")):
        sub.add_argument(name, default=default)
    sub = kinds.add_parser("ingest")
    sub.add_argument("logs", nargs="+")
    sub.add_argument("--append", default="results.csv")
    sub.add_argument("--json", default="results.json")
    args = parser.parse_args(argv)
    spark = session(args.kind)
    if args.kind == "ingest":
        found = [p for p in map(tables.resolved, args.logs) if "://" in p or os.path.exists(p)]
        rows = [r for p in found for r in logs.parse_loose(logs.read_lines(spark, p)).drop("file", "block").collect()]
        if rows:
            tables.append_rows(spark.createDataFrame(rows, benchmark.HARNESS), args.append)
        tables.extend_json([r.asDict() for r in rows], args.json)
        print(f"{len(rows)} rows of {len(found)} logs")
        return
    train, test, features = load(spark, args.train, args.test)
    threads = harness.threads_of()
    if args.kind == "compare":
        rows = harness.run(harness.library_jobs(features, ["id"], NAMED), train, test, threads)
        tables.append_rows(benchmark.checked(harness.rows_frame(spark, rows)), args.out_csv)
        tables.extend_json(rows, args.out_json)
    elif args.kind == "analytics":
        rows = storage.written(harness.protocol([job(a, features, params_of(a, [])) for a in benchmark.ALGORITHMS], train, test, threads), "rows")
        tables.write_benchmark(rows.drop("seq"), args.out)
        for report in (rows.drop("seq"), benchmark.speedups(rows, "seq"), benchmark.parity(rows, "seq")):
            report.show(truncate=False)
    else:
        model, train_ms = harness.timed(lambda: fitted(args.kind, train, features, params_of(args.kind, args.values)))
        row, infer_ms = harness.timed(lambda: evaluate.metrics(model.transform(test)).first())
        one = spark.createDataFrame([(args.kind, "serial", threads, train_ms, infer_ms, train_ms + infer_ms, row["accuracy"], row["prec"], row["recall"], row["f1"])], benchmark.BENCHMARK)
        print(benchmark.result_block(one).first()["block"])
