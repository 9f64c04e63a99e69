"""Queries on preparation, naive Bayes and the linear SVM, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import evaluate, naive_bayes, prep, svm
from orrery.plans.registry import registry
from orrery.plans.tasks import FEATURES, KEYS, NAMED, TASK_SQL, lineitem_task

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registry(QUERIES, ORACLE_SQL)


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Normalised training and test rows."""
    t = lineitem_task(spark, sf_dir)
    stats = prep.column_stats(t.where("not is_test"), FEATURES, NAMED)
    rows = prep.normalised(t, stats)
    return rows.where("not is_test"), rows.where("is_test")


_BINARY = {f: f"coalesce(bool_and(abs({f}) < 1e-9 OR abs({f} - 1) < 1e-9), true)" for f in FEATURES}
_STATS = ", ".join(f"{'true' if NAMED(f) else _BINARY[f]} AS b_{f}, avg(CAST({f} AS DOUBLE)) AS m_{f}, stddev_pop(CAST({f} AS DOUBLE)) AS s_{f}" for f in FEATURES)
_SCALED = ", ".join(f"CAST(CASE WHEN b_{f} THEN CAST({f} AS DOUBLE) ELSE (CAST({f} AS DOUBLE) - m_{f}) / CASE WHEN s_{f} < 1e-9 THEN 1 ELSE s_{f} END END AS FLOAT) AS {f}" for f in FEATURES)
_Z = f"WITH {TASK_SQL}, st AS (SELECT {_STATS} FROM t WHERE NOT is_test), z AS (SELECT {', '.join(KEYS)}, y, is_test, {_SCALED} FROM t, st)"


def _nb_sql(mode: str) -> str:
    aggs = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}, greatest(avg(CAST({f} AS DOUBLE) * {f}) - avg(CAST({f} AS DOUBLE)) ** 2, 1e-9) AS v_{f}, (count(*) FILTER ({f} > 0.5) + 1) / (count(*) + 2.0::DOUBLE) AS p_{f}" for f in FEATURES)
    mask = ", ".join(f"{({'gaussian': 'false', 'bernoulli': 'true'}).get(mode) or ('true' if NAMED(f) else _BINARY[f])} AS b_{f}" for f in FEATURES)
    terms = " + ".join(f"CASE WHEN b_{f} THEN ln(CASE WHEN {f} > 0.5 THEN p_{f} ELSE 1 - p_{f} END) ELSE -0.5 * ln(2 * pi() * v_{f}) - (CAST({f} AS DOUBLE) - m_{f}) ** 2 * (0.5 / v_{f}) END" for f in FEATURES)
    return f"""{_Z}, mk AS (SELECT {mask}, count(*) AS total FROM z WHERE NOT is_test),
g AS (SELECT y AS c, count(*) AS n, {aggs} FROM z WHERE NOT is_test GROUP BY y),
sc AS (SELECT {", ".join("z." + k for k in KEYS)}, z.y, g.c, ln((n + 1) / (total + 2.0::DOUBLE)) + {terms} AS s FROM z, g, mk WHERE z.is_test),
p AS (SELECT {", ".join(KEYS)}, y, CASE WHEN max(s) FILTER (c = 1) > max(s) FILTER (c = -1) THEN 1 ELSE -1 END AS pred FROM sc GROUP BY ALL)
"""


def _svm_sql(epochs: int, lr: float, decay: float = 1e-4) -> str:
    w = ", ".join(f"0::DOUBLE AS w_{f}" for f in FEATURES)
    out = f"{_Z}, tr AS (SELECT * FROM z WHERE NOT is_test), e0 AS (SELECT {w}, 0::DOUBLE AS bias)"
    dot = " + ".join(["bias", *(f"w_{f} * CAST({f} AS DOUBLE)" for f in FEATURES)])
    for e in range(epochs):
        step = ", ".join(f"(1 - {lr}::DOUBLE * {decay}::DOUBLE) * any_value(w_{f}) + {lr}::DOUBLE / count(*) * coalesce(sum(y * CAST({f} AS DOUBLE)) FILTER (y * ({dot}) < 1), 0) AS w_{f}" for f in FEATURES)
        out += f", e{e + 1} AS MATERIALIZED (SELECT {step}, any_value(bias) + {lr}::DOUBLE / count(*) * coalesce(sum(y) FILTER (y * ({dot}) < 1), 0) AS bias FROM tr, e{e})"
    return out + f", p AS (SELECT {', '.join(KEYS)}, y, CASE WHEN {dot} >= 0 THEN 1 ELSE -1 END AS pred FROM z, e{epochs} WHERE is_test)\n"


@query(f"WITH {TASK_SQL} SELECT is_test, y, count(*) AS n FROM t GROUP BY ALL")
def class_counts(spark, sf_dir):
    return lineitem_task(spark, sf_dir).groupBy("is_test", "y").agg(F.count("*").alias("n"))


_SCALED_COUNT = " + ".join(f"CASE WHEN b_{f} THEN 0 ELSE 1 END" for f in FEATURES)


@query(f"""WITH {TASK_SQL}, st AS (SELECT {_STATS} FROM t WHERE NOT is_test), k AS (SELECT CAST({_SCALED_COUNT} AS BIGINT) AS n_scaled FROM st)
SELECT is_test, count(*) AS n_rows, CAST({len(FEATURES)} AS BIGINT) AS n_features, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y <> 1) AS n_negative,
  any_value(n_scaled) AS n_scaled, CAST({len(FEATURES)} - any_value(n_scaled) AS BIGINT) AS n_passed FROM t, k GROUP BY is_test""")
def dataset_info(spark, sf_dir):
    t = lineitem_task(spark, sf_dir)
    return prep.dataset_info(t, FEATURES, prep.column_stats(t.where("not is_test"), FEATURES, NAMED))


@query(f"WITH {TASK_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) FILTER ({f} IS NULL) AS nulls FROM t" for f in FEATURES))
def null_counts(spark, sf_dir):
    return prep.null_counts(lineitem_task(spark, sf_dir), FEATURES)


@query(f"WITH {TASK_SQL}, st AS (SELECT {_STATS} FROM t WHERE NOT is_test) " + " UNION ALL ".join(f"SELECT '{f}' AS feature, b_{f} AS is_binary, CASE WHEN b_{f} THEN 0 ELSE round(m_{f}, 6) END AS mean, CASE WHEN b_{f} OR s_{f} < 1e-9 THEN 1 ELSE round(s_{f}, 6) END AS sd FROM st" for f in FEATURES))
def zscore_stats(spark, sf_dir):
    s = prep.stats_frame(lineitem_task(spark, sf_dir).where("not is_test"), FEATURES, NAMED)
    return s.select("feature", "is_binary", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"{_Z} SELECT {', '.join(KEYS)}, y, is_test, {', '.join(f'round(CAST({f} AS DOUBLE), 4) AS {f}' for f in FEATURES)} FROM z")
def zscore_rows(spark, sf_dir):
    train, test = _prepared(spark, sf_dir)
    return train.union(test).select(*KEYS, "y", "is_test", *(F.round(F.col(f).cast("double"), 4).alias(f) for f in FEATURES))


def _nb(spark, sf_dir, mode):
    train, test = _prepared(spark, sf_dir)
    return naive_bayes.predict(test, naive_bayes.fit(train, FEATURES, mode, NAMED))


@query(f"{_nb_sql('hybrid')} SELECT {', '.join(KEYS)}, y, pred FROM p")
def nb_predict(spark, sf_dir):
    return _nb(spark, sf_dir, "hybrid").select(*KEYS, "y", "pred")


@query(_nb_sql("hybrid") + evaluate.METRICS_SQL)
def nb_metrics(spark, sf_dir):
    return evaluate.metrics(_nb(spark, sf_dir, "hybrid"))


@query(_nb_sql("gaussian") + evaluate.METRICS_SQL)
def nb_gaussian_only(spark, sf_dir):
    return evaluate.metrics(_nb(spark, sf_dir, "gaussian"))


@query(_nb_sql("bernoulli") + evaluate.METRICS_SQL)
def nb_bernoulli_only(spark, sf_dir):
    return evaluate.metrics(_nb(spark, sf_dir, "bernoulli"))


def _svm(spark, sf_dir, epochs, lr):
    train, test = _prepared(spark, sf_dir)
    return svm.predict(test, FEATURES, svm.fit(train, FEATURES, epochs, lr))


@query(_svm_sql(20, 0.02) + f"SELECT {', '.join(KEYS)}, y, pred FROM p")
def svm_predict(spark, sf_dir):
    return _svm(spark, sf_dir, 20, 0.02).select(*KEYS, "y", "pred")


@query(_svm_sql(20, 1.0) + evaluate.METRICS_SQL)
def svm_metrics_lr1(spark, sf_dir):
    return evaluate.metrics(_svm(spark, sf_dir, 20, 1.0))
