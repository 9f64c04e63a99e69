"""Runs estimators one after the other and reports a row for each: times, metrics and what was run.

An estimator is ``fit(train) -> model`` with ``model.transform(rows)`` adding pred. Times are those of whole actions.
"""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import storage
from orrery.operators import benchmark, boosted, evaluate, exact_tree, hinge_sgd, knn, mlp, naive_bayes, svm, tree
from orrery.operators.prep import Named, never


@dataclass(frozen=True)
class Job:
    algorithm: str
    framework: str
    variant: str
    fit: Callable[[DataFrame], object]
    notes: str = ""


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """What an action returns, and its milliseconds."""
    start = time.perf_counter()
    return action(), (time.perf_counter() - start) * 1000


def report(job: Job, train: DataFrame, test: DataFrame, threads: int) -> dict:
    """The harness row of one job; inference is timed with the metrics, whose rows are counted in the same pass."""
    model, train_ms = timed(lambda: job.fit(train))
    row, infer_ms = timed(lambda: evaluate.metrics(model.transform(test)).first())
    return {
        "algorithm": job.algorithm, "framework": job.framework, "variant": job.variant, "n_threads": threads, "train_ms": round(train_ms, 2), "infer_ms": round(infer_ms, 2),
        "acc": round(row["accuracy"], 4), "prec": round(row["prec"], 4), "rec": round(row["recall"], 4), "f1": round(row["f1"], 4), "notes": job.notes,
    }


def run(jobs: Iterable[Job], train: DataFrame, test: DataFrame, threads: int = 1) -> list[dict]:
    """A row for each job; one that fails is told on stderr and left out. Raises if none is left."""
    rows = []
    for job in jobs:
        try:
            rows.append(report(job, train, test, threads))
        except Exception as error:  # noqa: BLE001  (one failing job doesn't stop the others)
            print(f"warning: {job.algorithm} ({job.framework}) failed: {error}", file=sys.stderr)
    if not rows:
        raise RuntimeError("no job gave a row")
    return rows


def rows_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    columns = [c.split()[0] for c in benchmark.HARNESS.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], benchmark.HARNESS)


class WideNeighbours:
    """k-NN on rows whose features are columns."""

    def __init__(self, train: DataFrame, features: list[str], params: knn.Params = knn.Params()):
        self.features = features
        self.model = knn.fit_model(self._packed(train), params, key="_id", vector="_features")

    def _packed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_id": F.monotonically_increasing_id(), "_features": F.array(*(F.col(f).cast("double") for f in self.features))})

    def transform(self, rows: DataFrame) -> DataFrame:
        # written, since the numbers of the rows have to be the same on both sides of the vote's join
        return self.model.transform(storage.written(self._packed(rows), "asked")).drop("_id", "_features")


def own_jobs(features: list[str], keys: list[str], named: Named = never) -> list[Job]:
    """The engine's estimators on wide rows (features, y)."""
    return [
        Job("svm", "ours", "spark", lambda t: svm.fit_model(t, features)),
        Job("knn", "ours", "spark", lambda t: WideNeighbours(t, features)),
        Job("mlp", "ours", "spark", lambda t: mlp.fit_full(t, features), "a step an epoch on all rows"),
        Job("dt", "ours", "spark", lambda t: tree.fit(t, features)),
        Job("nb", "ours", "hybrid", lambda t: naive_bayes.fit_model(t, features, named=named)),
    ]


def library_jobs(features: list[str], keys: list[str], named: Named = never, *, epochs: int = 20) -> list[Job]:
    """The other models for the same tasks, as baselines: steps a row, k-NN, minibatches, exact and boosted trees, mixed naive
    Bayes and its two ablations. keys identify a row."""
    bayes = lambda mode: lambda t: naive_bayes.fit_model(t, features, naive_bayes.Params(mode))
    return [
        Job("svm", "ours", "sgd", lambda t: hinge_sgd.fit(t, features, keys, hinge_sgd.Params(epochs=epochs)), "a step a row"),
        Job("knn", "ours", "spark", lambda t: WideNeighbours(t, features), "k = 11, uniform votes"),
        Job("mlp", "ours", "minibatch", lambda t: mlp.fit(t, features, keys, mlp.Params(epochs=epochs)), "batches of 128 rows, momentum"),
        Job("dt", "ours", "exact", lambda t: exact_tree.fit(t, features), "all distinct cuts"),
        Job("dt", "ours", "boosted", lambda t: boosted.fit(t, features), "one boosted histogram tree"),
        Job("nb", "ours", "hybrid", lambda t: naive_bayes.fit_model(t, features, named=named)),
        Job("nb", "ours", "gaussian", bayes("gaussian"), "ablation"),
        Job("nb", "ours", "bernoulli", bayes("bernoulli"), "ablation"),
    ]


def protocol(jobs: Iterable[Job], train: DataFrame, test: DataFrame, threads: int) -> DataFrame:
    """seq and benchmark rows of every job in a serial run (one partition) and in one of ``threads`` partitions, named omp."""
    rows = []
    for variant, parts in (("serial", 1), ("omp", threads)):
        dealt = [storage.written(df.repartition(parts), variant).repartition(parts) for df in (train, test)]
        rows += [{**r, "variant": variant} for r in run(jobs, *dealt, parts)]
    told = [(i, r["algorithm"], r["variant"], r["n_threads"], r["train_ms"], r["infer_ms"], round(r["train_ms"] + r["infer_ms"], 2), r["acc"], r["prec"], r["rec"], r["f1"]) for i, r in enumerate(rows)]
    return train.sparkSession.createDataFrame(told, f"seq long, {benchmark.BENCHMARK}")


def thread_budget(algorithm: str, threads: int) -> dict[str, str]:
    """Environment of the workers: numpy keeps to one thread where tasks run side by side (k-NN); the sequential perceptron
    may use all; others keep what they have."""
    if algorithm not in ("knn", "mlp"):
        return {}
    n = str(1 if algorithm == "knn" else threads)
    return {"OMP_NUM_THREADS": n, "OPENBLAS_NUM_THREADS": n, "MKL_NUM_THREADS": n}


def block_of(name: str, default: int, env: dict[str, str] = os.environ) -> int:  # type: ignore[assignment]
    """The block size that a variable of the environment gives; the default where it is unset, no number or below 1."""
    try:
        n = int(env.get(name, default))
    except ValueError:
        return default
    return n if n >= 1 else default


def threads_of(env: dict[str, str] = os.environ, default: int = 8) -> int:  # type: ignore[assignment]
    """N_THREADS, at least 1; the default where it is unset or no number."""
    try:
        return max(1, int(env.get("N_THREADS", default)))
    except ValueError:
        return default
