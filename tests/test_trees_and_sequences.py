"""Exact and boosted trees, order statistics by keys, hinge descent and minibatches against plain numpy."""

import numpy as np
import pytest

from orrery import storage
from orrery.operators import blocks, boosted, exact_tree, hinge_sgd, knn, mlp, order_keys, ordering, sequences, tree


def table(spark, n=1300, parts=3, seed=2):
    draw = np.random.default_rng(seed)
    rows = [(i, float(a), float(round(b, 1)), float(i % 2), 1 if a * b > 0 else -1) for i, (a, b) in enumerate(draw.normal(size=(n, 2)))]
    return rows, spark.createDataFrame(rows, "id long, a float, b float, c float, y int").repartition(parts)


def in_order(df, keys):
    """id by id as they are dealt."""
    return [r["id"] for r in df.withColumn("o", ordering.shuffled(df, keys, 42)).orderBy("o").collect()]


def test_keys_sort_as_values_do():
    x = np.array([-np.inf, -3.5, -1e-40, -0.0, 0.0, 1e-40, 2.0, 3.0, np.inf], np.float32)
    k = order_keys.keys_of(x)
    assert k[3] == k[4] and (np.diff(np.delete(k, 3).astype(np.int64)) > 0).all()
    assert order_keys.values_of(k).tolist() == (x + np.float32(0)).astype(float).tolist()


@pytest.mark.parametrize("parts", [1, 5])
def test_edges_are_those_of_the_sorted_columns(spark, parts):
    draw = np.random.default_rng(6)
    x = np.stack([draw.normal(size=3000), draw.integers(0, 65, 3000), draw.integers(0, 64, 3000), np.full(3000, 7.0), draw.integers(-2, 1000, 3000) * 1e-3], axis=1).astype(np.float32)
    df = spark.createDataFrame([(*map(float, r), 1) for r in x], "a float, b float, c float, d float, e float, y int").repartition(parts)
    for bins in (64, 128):
        found = tree.bin_edges(blocks.packed(df, list("abcde")), list("abcde"), bins)
        for j, f in enumerate("abcde"):
            values = np.sort(x[:, j].astype(float))
            own = np.unique(values)
            want = ((own[:-1] + own[1:]) * 0.5).tolist() if len(own) <= bins else [values[b * 3000 // bins] for b in range(1, bins)]
            assert found[f] == want, (f, bins)


def test_edges_without_rows_and_odd_bins(spark):
    none = spark.createDataFrame([], "a float, y int")
    assert tree.bin_edges(blocks.packed(none, ["a"]), ["a"]) == {"a": []}
    for bins in (1, 257):
        with pytest.raises(ValueError):
            tree.Params(bins=bins)


def test_slabs_and_sweeps_in_tasks_grow_the_same_tree(spark, monkeypatch):
    _, df = table(spark)
    told = lambda: [(n.feature, n.threshold, n.pos, n.neg) for n in tree.fit(df, ["a", "b", "c"], tree.Params(max_depth=4, bins=128)).nodes]
    want = told()
    monkeypatch.setattr(tree, "SLAB", 1)
    monkeypatch.setattr(tree, "DRIVER_CELLS", 0)
    assert told() == want and len(want) > 8


def plain_exact(x, y, depth, node=0):
    """(feature, threshold, left, right) or the class."""
    gini = lambda v: 1 - (np.mean(v == 1) ** 2 + np.mean(v != 1) ** 2)
    best = None
    if depth and len(y) >= 20 and len(set(y)) > 1:
        for j in range(x.shape[1]):
            own = np.unique(x[:, j])
            for cut in (own[:-1] + own[1:]) / 2:
                left = x[:, j] <= cut
                if min(left.sum(), (~left).sum()) >= 5:
                    gain = gini(y) - left.mean() * gini(y[left]) - (~left).mean() * gini(y[~left])
                    if gain >= 1e-7 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, j, cut)
    if best is None:
        return 1 if (y == 1).sum() >= (y != 1).sum() else -1
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], plain_exact(x[left], y[left], depth - 1), plain_exact(x[~left], y[~left], depth - 1)


def nested(nodes, at=0):
    n = nodes[at]
    return n.prediction if n.feature < 0 else (n.feature, n.threshold, nested(nodes, n.left), nested(nodes, n.right))


@pytest.mark.parametrize("size", [10_000, 37])
def test_exact_tree_equals_all_cuts(spark, size):
    rows, df = table(spark, 400)
    model = exact_tree.fit(df, ["a", "b", "c"], tree.Params(max_depth=3), range_rows=size)
    x = np.array([r[1:4] for r in rows], np.float32).astype(float)
    assert nested(model.nodes) == plain_exact(x, np.array([r[4] for r in rows]), 3)
    assert model.transform(df).where("pred is null").count() == 0


@pytest.mark.parametrize("size, few", [(37, 2), (5, 2), (200, 30), (37, 0)])
def test_exact_tree_with_heavy_values_equals_all_cuts(spark, size, few):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 3)).astype(np.float32)
    x[draw.random(300) < 0.5, 0], x[:100, 1], x[:, 2] = 0.25, -0.0, np.round(x[:, 2], 1)
    y = np.where(x[:, 0] + x[:, 1] * x[:, 2] > 0.2, 1, -1)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a float, b float, c float, y int").repartition(3)
    model = exact_tree.fit(df, ["a", "b", "c"], tree.Params(max_depth=4), range_rows=size, few=few)
    assert nested(model.nodes) == plain_exact(x.astype(float), y, 4)


def test_exact_tree_writes_and_deals_no_values_level_by_level(spark, monkeypatch):
    rows, df = table(spark, 400)
    written, write = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, name: written.append(name) or write(df, name))
    model = exact_tree.fit(df, ["a", "b", "c"], tree.Params(max_depth=3), range_rows=37)
    assert max(n.depth for n in model.nodes) == 3 and len(written) <= 1


def test_trees_of_no_rows_and_null_features(spark):
    none = spark.createDataFrame([], "a float, y int")
    some = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "a float")
    assert [r["pred"] for r in exact_tree.fit(none, ["a"]).transform(some).collect()] == [1, None, None]
    assert [(r["margin"], r["pred"]) for r in boosted.fit(none, ["a"]).transform(some).collect()] == [(0.0, -1), (None, None), (None, None)]


def test_boosting_lowers_the_loss_and_weights_are_newton_steps(spark):
    rows, df = table(spark)
    loss = []
    for rounds in (0, 1, 4):
        model = boosted.fit(df, ["a", "b"], boosted.Params(rounds=rounds, max_depth=3, lr=0.5, reg=1.0))
        found = {r["id"]: r["margin"] for r in model.transform(df).collect()}
        m, t = np.array([found[r[0]] for r in rows]), np.array([r[4] == 1 for r in rows], float)
        loss.append(mlp.losses(m, t).mean())
    assert loss[0] == pytest.approx(np.log(2)) and loss[0] > loss[1] > loss[2]
    x, y = np.array([r[1:3] for r in rows], np.float32), np.array([r[4] for r in rows])
    before = boosted.derivatives(model.trees[:-1], model.weights[:-1])(x, y)
    at = tree.walk(x, model.trees[-1])
    for leaf in set(at):
        g, h = (v[at == leaf].sum() for v in before)
        assert model.weights[-1][leaf] == pytest.approx(-0.5 * g / (h + 1.0), abs=1e-9)


@pytest.mark.parametrize("parts", [1, 4])
def test_hinge_descent_equals_numpy(spark, parts):
    rows, df = table(spark, 333)
    by_id = {r[0]: r for r in rows}
    order = in_order(df, ["id"])
    model = hinge_sgd.fit(df, ["a", "b", "c"], ["id"], hinge_sgd.Params(epochs=1, parts=parts))
    done = []
    for p in range(parts):
        mine = [by_id[i] for i in order[p::parts]]
        w, b = np.zeros(3), 0.0
        for _, *x, y in mine:
            x = np.array(x, np.float32).astype(float)
            active = y * (w @ x + b) < 1
            w = (1 - 0.02 * 1e-4) * w + (0.02 * y * x if active else 0)
            b += 0.02 * y if active else 0
        done.append((len(mine) / 333, w, b))
    assert np.allclose(model.weights, sum(n * w for n, w, _ in done), atol=1e-12) and model.bias == pytest.approx(sum(n * b for n, _, b in done))
    assert hinge_sgd.fit(df.where("false"), ["a"], ["id"]).weights == [0.0]


@pytest.mark.parametrize("noise", [0.0, 2.0])
def test_looking_ahead_takes_the_same_steps(noise):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(3000, 4)).astype(np.float32)
    y = np.where(3 * x[:, 0] + noise * draw.normal(size=3000) > 0.1, 1, -1).astype(np.int8)
    w, b = np.zeros(4), 0.0
    for row, t in zip(x.astype(float), y.astype(float)):
        active = t * (row @ w + b) < 1
        w, b = (1 - 0.02 * 1e-4) * w + (0.02 * t * row if active else 0), b + (0.02 * t if active else 0)
    found = hinge_sgd.steps(x, y, np.zeros(4), 0.0, hinge_sgd.Params())
    assert np.allclose(found[0], w, rtol=0, atol=1e-12) and found[1] == pytest.approx(b)


@pytest.mark.parametrize("workers, batch", [(1, 1), (3, 1), (2, 7)])
def test_blocks_of_a_worker_are_whole_and_in_order(spark, monkeypatch, workers, batch):
    monkeypatch.setattr(blocks, "ROWS", 64)
    rows, df = table(spark, 700)
    by_id, order = {r[0]: r for r in rows}, in_order(df, ["id"])
    told = sequences.dealt(df, ["a"], ["id"], workers, batch=batch)
    assert told.rows == 700
    for worker in range(workers):
        mine = [by_id[i] for at, i in enumerate(order) if at % (batch * workers) // batch == worker]
        found = list(told.blocks(worker, 42, 0))
        assert np.concatenate([x[:, 0] for x, _ in found]).tolist() == [np.float32(r[1]) for r in mine]
        assert np.concatenate([y for _, y in found]).tolist() == [r[4] for r in mine] and max(len(y) for _, y in found) <= 64


@pytest.mark.parametrize("workers", [1, 3])
def test_minibatches_equal_numpy_and_can_go_on(spark, workers, tmp_path):
    _, df = table(spark, 1000)
    features = ["a", "b", "c"]
    params = mlp.Params(epochs=2, lr=0.1, batch=32, hidden=(6, 4), workers=workers)
    start = mlp.initial(3, params)
    model = mlp.fit(df, features, ["id"], params, start, saved=f"{tmp_path}/s")
    told = sequences.dealt(df, features, ["id"], workers, batch=32)
    first = [x for w in range(workers) for x, _ in told.blocks(w, 42, 0)]
    at = {r["id"]: (r["a"], r["b"], r["c"]) for r in df.collect()}
    order = in_order(df, ["id"])
    want = [[at[i] for k, i in enumerate(order) if k % (32 * workers) // 32 == w] for w in range(workers)]
    assert np.allclose(np.concatenate(first), np.concatenate([np.array(x) for x in want]))
    w, speed = {n: v.copy() for n, v in start.items()}, {n: np.zeros_like(v) for n, v in start.items()}
    for epoch in range(2):
        xs, ys = zip(*((np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) for found in (list(told.blocks(k, 42, epoch)) for k in range(workers))))
        for step in range(1000 // (32 * workers)):
            cut = slice(32 * step, 32 * step + 32)
            x, y = np.concatenate([v[cut] for v in xs]).astype(float), np.concatenate([v[cut] for v in ys])
            _, grad = mlp.backward(w, x, (y == 1).astype(float))
            mlp.update(w, speed, grad, len(x), 0.1 / np.sqrt(epoch + 1), params)
    assert len(model.epoch_loss) == 2 and all(np.allclose(model.weights[n], w[n], atol=1e-9) for n in mlp.LAYERS)
    more = mlp.fit(df, features, ["id"], mlp.Params(epochs=3, lr=0.1, batch=32, hidden=(6, 4), workers=workers), start, saved=f"{tmp_path}/s")
    assert more.epoch_loss[:2] == model.epoch_loss and len(more.epoch_loss) == 3


def test_less_than_a_step_trains_nothing(spark):
    _, df = table(spark, 100)
    assert mlp.fit(df, ["a"], ["id"], mlp.Params(batch=32, workers=4)).epoch_loss == []


def test_shells_skip_rows_and_stay_exact():
    draw = np.random.default_rng(8)
    middle = draw.normal(size=(30, 5)) * 20
    x = np.repeat(middle, 100, axis=0) + draw.normal(size=(3000, 5))
    ids, y, pivots = draw.permutation(3000), draw.integers(0, 2, 3000).astype(np.int32), x[::100]
    near = ((x[:, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
    shells = []
    for p in range(30):
        own = np.flatnonzero(near == p)
        far = np.sqrt(((x[own] - pivots[p]) ** 2).sum(axis=1))
        own, far = own[np.argsort(far)], np.sort(far)
        shells += [knn.Shell(p, far[i : i + 40].min(), far[i : i + 40].max(), ids[own[i : i + 40]], x[own[i : i + 40]], y[own[i : i + 40]]) for i in range(0, len(own), 40)]
    q = x[:60] + 0.1
    best = knn.Best(q, 7, pivots)
    best.visit(shells)
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    for r in range(60):
        want = sorted(zip(d[r].tolist(), ids.tolist()))[:7]
        assert [i for _, i in want] == best.ids[r].tolist() and np.allclose([v for v, _ in want], best.d[r])
    assert best.compared < 0.25 * d.size
