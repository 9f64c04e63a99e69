"""Every query against its SQL, and the estimators on small and odd inputs."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import catalog
from orrery.operators import blocks, evaluate, knn, mlp, naive_bayes, ordering, prep, svm, tree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(row):
    return tuple(x + 0.0 if isinstance(x, float) else x for x in row)  # -0.0 is 0.0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    said = duck.execute(catalog.ORACLE_SQL[name])
    at = [found.columns.index(c[0]) for c in said.description]
    assert len(at) == len(found.columns)
    assert sorted(map(plain, said.fetchall()), key=str) == sorted((plain(r[i] for i in at) for r in found.collect()), key=str)


def test_constant_column_becomes_zero_and_then_binary(spark):
    train = spark.createDataFrame([(5.0, 1), (5.0, -1)], "x float, y int")
    stats = prep.column_stats(train, ["x"])
    assert stats["x"] == (False, 5.0, 1.0)
    assert naive_bayes.fit(prep.normalised(train, stats), ["x"])["features"]["x"][0] is True


def test_binary_columns_by_name_and_within_tolerance(spark):
    df = spark.createDataFrame([(1 + 1e-10, 3.0), (0.0, 4.0)], "x double, map_a double")
    assert prep.column_stats(df, ["x"])["x"][0] is True
    assert prep.column_stats(df, ["map_a"], prep.by_name("map_", "planted"))["map_a"] == (True, 0.0, 1.0)
    assert prep.column_stats(df, ["map_a"])["map_a"][0] is False
    assert not prep.by_name("map_", "planted")("planted_2")


def test_empty_training_rows(spark):
    none = spark.createDataFrame([], "x float, y int")
    some = spark.createDataFrame([(1.0, 1), (None, -1)], "x float, y int")
    assert prep.column_stats(none, ["x"])["x"] == (True, 0.0, 1.0)
    assert svm.fit(none, ["x"]) == ([0.0], 0.0)
    assert naive_bayes.fit(none, ["x"])["prior"] == {-1: 0.5, 1: 0.5}
    assert [r["pred"] for r in tree.fit(none, ["x"]).transform(some).collect()] == [1, None]
    assert mlp.fit(none.selectExpr("1L as id", "x", "y"), ["x"], ["id"]).epoch_loss == []


def test_null_features_take_no_part_and_have_no_prediction(spark):
    rows = [(float(i), 1 if i > 5 else -1) for i in range(12)]
    df = spark.createDataFrame([*rows, (None, 1), (float("nan"), -1)], "x float, y int")
    plain_ = spark.createDataFrame(rows, "x float, y int")
    assert svm.fit(df, ["x"]) == svm.fit(plain_, ["x"]) and naive_bayes.fit(df, ["x"]) == naive_bayes.fit(plain_, ["x"])
    null = df.where("x is null")
    assert [svm.predict(null, ["x"], ([1.0], 0.0)).first()["pred"], naive_bayes.fit_model(plain_, ["x"]).transform(null).first()["pred"]] == [None, None]


def test_metrics_of_no_rows_are_zero(spark):
    row = evaluate.metrics(spark.createDataFrame([], "y int, pred int")).first()
    assert tuple(row) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)


def test_negative_parameters_count_as_bounds():
    assert knn.Params(5, 0).block == mlp.Params(block=-4).block == 1
    assert svm.Params(-1, -0.5, -1) == svm.Params(0, 0, 0) and knn.Params(0).k == 1 and tree.Params(-3).max_depth == 1 and mlp.Params(-1).epochs == 0


def test_neighbours_votes_ties_and_odd_rows(spark):
    train = [(1, [0.0, 0.0], 1), (2, [0.0, 0.0], -1), (3, [1.0, 0.0], -1), (4, [0.0, 1.0], 1), (5, None, 1), (6, [None, 0.0], 1), (7, [float("nan"), 0.0], 1), (8, [0.0], 1)]
    df = spark.createDataFrame(train, "id long, features array<double>, y int")
    asked = spark.createDataFrame([(10, [0.0, 0.0], 1), (11, [0.9, 0.0], 1), (12, None, 1)], "id long, features array<double>, y int")
    found = {}
    for r in knn.neighbours(df, asked, 3).collect():
        found.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
    assert sorted(found[10]) == [(1, 1), (2, 2), (3, 3)] and sorted(found[11]) == [(1, 3), (2, 1), (3, 2)]
    pred = lambda k: {r["id"]: r["pred"] for r in knn.fit_model(df, knn.Params(k)).transform(asked).collect()}
    assert pred(2) == {10: 1, 11: -1, 12: -1}  # a tie goes to the nearest, no neighbour is -1
    assert pred(99)[10] == 1  # all four, two of each class
    for block in (1, 2):
        assert knn.neighbours(df, asked, 3, block=block).select("query", "rank", "neighbour").subtract(knn.neighbours(df, asked, 3).select("query", "rank", "neighbour")).count() == 0
        assert {r["id"]: r["pred"] for r in knn.fit_model(df, knn.Params(2, block)).transform(asked).collect()} == pred(2)


def test_tree_with_mass_at_an_edge_and_the_same_labels_for_any_partitions(spark):
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(size=300), np.full(60, 3.0)]).astype(np.float32)
    rows = [(float(v), float(i % 7), 1 if v + (i % 7) / 3 > 1 else -1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a float, b float, y int")
    models = [tree.fit(df.repartition(n), ["a", "b"]) for n in (1, 4, 16)]
    told = [[(n.feature, n.threshold, n.pos, n.neg) for n in m.nodes] for m in models]
    assert told[0] == told[1] == told[2] and len(told[0]) > 3
    assert all(n.pos + n.neg >= 20 for n in models[0].nodes if n.feature >= 0)
    walked = [r["pred"] for r in models[0].transform(df).orderBy("a", "b").collect()]
    order = sorted((r[:2] for r in rows))
    assert walked == [models[0].nodes[i].prediction for i in tree.walk(np.array(order, np.float32), models[0].nodes)]


def test_perceptron_drops_the_tail_and_learns(spark):
    draw = np.random.default_rng(2)
    rows = [(i, float(a), float(b), 1 if a * b > 0 else -1) for i, (a, b) in enumerate(draw.normal(size=(1300, 2)))]
    df = spark.createDataFrame(rows, "id long, a float, b float, y int")
    for n, batches in ((127, 0), (128, 1), (130, 1)):
        assert ordering.minibatches(df.where(f"id < {n}"), ["id"]).count() == 128 * batches
    model = mlp.fit(df, ["a", "b"], ["id"], mlp.Params(epochs=6, lr=0.1, hidden=(16, 8)))
    assert model.epoch_loss[-1] < model.epoch_loss[0]
    assert evaluate.metrics(model.transform(df)).first()["accuracy"] > 0.85
    small = mlp.Model(model.features, model.weights, [], 7).transform(df).select("id", F.col("logit").alias("small"))
    assert small.join(model.transform(df), "id").where("abs(small - logit) > 1e-9").count() == 0 and small.count() == len(rows)


def test_gradient_equals_finite_differences():
    w = mlp.initial(3, mlp.Params(hidden=(5, 4)))
    w["w3"] *= 50
    draw = np.random.default_rng(3)
    x, t = draw.normal(size=(20, 3)), (draw.random(20) > 0.5).astype(float)
    _, grad = mlp.backward(w, x, t)
    for name in mlp.LAYERS:
        for at in list(np.ndindex(w[name].shape))[:4]:
            up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert abs((mlp.backward(up, x, t)[0] - mlp.backward(down, x, t)[0]) / 2e-6 - grad[name][at]) < 1e-3


def test_long_gradients_add_up_like_short_ones(spark):
    df = spark.createDataFrame([(float(i), 1 if i % 3 else -1) for i in range(50)], "x float, y int").repartition(3)
    rows = blocks.packed(df, ["x"])
    count = lambda x, y: np.array([len(y), x.sum()])
    assert blocks.summed(rows, 2, count).tolist() == mlp._summed_long(rows, 2, count).tolist() == [50, 1225]


def test_ranks_and_statistics_over_many_ranges(spark):
    draw = np.random.default_rng(4)
    values = draw.integers(0, 90, 3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, x double").repartition(7)
    ranks = {r["id"]: r["rank"] for r in ordering.ranked(df, ["x", "id"]).collect()}
    assert [ranks[i] for i in sorted(range(3000), key=lambda i: (values[i], i))] == list(range(1, 3001))
    asked = {"x": [0, 1, 1499, 2999]}
    found = {r["position"]: r["value"] for r in ordering.order_statistics(ordering.value_counts(df, ["x"]), asked).collect()}
    assert found == {p: float(np.sort(values)[p]) for p in asked["x"]}
