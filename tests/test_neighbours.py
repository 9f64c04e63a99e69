import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import knn


def frame(spark, ids, x, y):
    return spark.createDataFrame([(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, x, y)], "id long, features array<double>, y int")


@pytest.mark.parametrize("width", [2, 9])
def test_copies_and_ties_equal_brute_force_in_all_tasks(spark, width):
    draw = np.random.default_rng(width)
    x = np.concatenate([draw.integers(0, 6, (2000, width)), np.ones((1500, width)), draw.normal(size=(1500, width))]).astype(np.float64)
    ids, y = draw.permutation(len(x)), draw.choice([-1, 1], len(x))
    q = np.concatenate([draw.integers(-1, 7, (300, width)), np.ones((200, width)), draw.normal(size=(100, width)) * 3]).astype(np.float64)
    found = knn.neighbours(frame(spark, ids, x, y), frame(spark, range(len(q)), q, np.ones(len(q))), 7, block=32).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in found}) == 4  # the queries aren't met by one task
    got = {(r["query"], r["rank"]): (r["neighbour"], r["y"], r["distance"]) for r in found}
    assert len(got) == len(found) == 7 * len(q)
    for i in range(len(q)):
        d = ((x - q[i]) ** 2).sum(axis=1)
        for rank, j in enumerate(np.lexsort((ids, d))[:7], 1):
            assert got[i, rank] == (ids[j], y[j], d[j])


def test_a_task_compares_few_of_all_pairs():
    draw = np.random.default_rng(3)
    x = draw.uniform(size=(40_000, 3))
    cells = knn.Cells(x[::10], 50)
    at = cells.of(x)
    assert sorted(set(at.tolist())) == list(range(cells.cells)) and np.bincount(at).max() < 1500
    shells = [knn.Shell(0, 0.0, 9.0, own, x[own], np.ones(len(own), np.int32)) for own in (np.flatnonzero(at == c) for c in range(cells.cells))]
    low, high = (np.array([getattr(s, side) for s in shells]) for side in ("low", "high"))
    directory = knn.Directory([("", c, len(s.ids)) for c, s in enumerate(shells)], *np.zeros((3, len(shells)), int), low, high)
    directory.read = lambda i, width: shells[i]
    q = draw.uniform(size=(1000, 3))
    q = q[np.argsort(cells.of(q), kind="stable")]
    found = knn.look_up(q, 5, 50, x[:1], knn.Reader(directory, 3))
    assert sum(b.compared for b in found) < 0.1 * len(q) * len(x)
    for r, ids in enumerate(np.concatenate([b.ids for b in found])[::20]):
        assert ids.tolist() == np.argsort(((x - q[r * 20]) ** 2).sum(axis=1))[:5].tolist()


def test_no_training_rows_no_queries_and_fewer_rows_than_k(spark):
    none = spark.createDataFrame([], "id long, features array<double>, y int")
    some = frame(spark, [1, 2], np.zeros((2, 3)), [1, -1])
    assert knn.neighbours(none, some).count() == knn.neighbours(some, none).count() == 0
    assert sorted((r["query"], r["rank"], r["neighbour"]) for r in knn.neighbours(some, some, 300).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2)]
