"""Queries on nearest neighbours, trees, perceptrons, encodings, orders and scalar functions, and their SQL."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalar
from orrery.operators import boosted, encode, evaluate, exact_tree, hinge_sgd, knn, mlp, ordering, prep, tree
from orrery.plans.bayes_svm import _Z, _prepared
from orrery.plans.registry import registry
from orrery.plans.tasks import FEATURES, KEYS, TASK_SQL, embedding_task, lineitem_task

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registry(QUERIES, ORACLE_SQL)

# --- nearest neighbours -----------------------------------------------------------------------------------------------------

_KNN = """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y FROM embeddings),
n AS (SELECT q.id AS query, q.y AS own, t.id AS neighbour, t.y, list_sum(list_transform(list_zip(q.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
  FROM e q JOIN e t ON q.id % 5 = 0 AND t.id % 5 <> 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INTEGER) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) <= 11),
v AS (SELECT query, any_value(own) AS y, sum(y) AS votes, min_by(y, rank) AS nearest FROM r GROUP BY query),
p AS (SELECT query AS id, y, CAST(CASE WHEN votes > 0 THEN 1 WHEN votes < 0 THEN -1 ELSE nearest END AS INTEGER) AS pred FROM v)
"""


def _knn_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = embedding_task(spark, sf_dir)
    return t.where("not is_test"), t.where("is_test")


@query(_KNN + "SELECT query, rank, neighbour, round(distance, 6) AS distance FROM r")
def knn_neighbours(spark, sf_dir):
    train, test = _knn_parts(spark, sf_dir)
    return knn.neighbours(train, test).select("query", "rank", "neighbour", F.round("distance", 6).alias("distance"))


@query(_KNN + "SELECT id, y, pred FROM p")
def knn_predict(spark, sf_dir):
    train, test = _knn_parts(spark, sf_dir)
    return knn.fit_model(train).transform(test).select("id", "y", "pred")


@query(_KNN + evaluate.METRICS_SQL)
def knn_metrics(spark, sf_dir):
    train, test = _knn_parts(spark, sf_dir)
    return evaluate.metrics(knn.fit_model(train).transform(test))


# --- tree -------------------------------------------------------------------------------------------------------------------

_EDGES = f"""{_Z}, zr AS (SELECT row_number() OVER () AS id, * FROM z),
long AS (UNPIVOT (SELECT id, y, is_test, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)} FROM zr) ON {', '.join(FEATURES)} INTO NAME feature VALUE x),
cnt AS (SELECT feature, x, count(*) AS c FROM long WHERE NOT is_test GROUP BY ALL),
sz AS (SELECT feature, count(*) AS k, CAST(sum(c) AS BIGINT) AS total FROM cnt GROUP BY feature),
few AS (SELECT feature, row_number() OVER w AS b, (x + lead(x) OVER w) * 0.5::DOUBLE AS edge FROM cnt JOIN sz USING (feature) WHERE k <= 64 WINDOW w AS (PARTITION BY feature ORDER BY x)),
cum AS (SELECT feature, x, c, total, CAST(sum(c) OVER (PARTITION BY feature ORDER BY x) AS BIGINT) AS u FROM cnt JOIN sz USING (feature) WHERE k > 64),
many AS (SELECT feature, b, x AS edge FROM cum, (SELECT unnest(range(1, 64)) AS b) WHERE (b * total) // 64 >= u - c AND (b * total) // 64 < u),
edges AS (SELECT feature, b, edge FROM few WHERE edge IS NOT NULL UNION ALL SELECT feature, b, edge FROM many)
"""
_NUMBER = "CASE feature " + " ".join(f"WHEN '{f}' THEN {j}" for j, f in enumerate(FEATURES)) + " END"
_BINNED = f"""{_EDGES}, el AS (SELECT feature, list(edge ORDER BY b) AS es FROM edges GROUP BY feature),
bl AS MATERIALIZED (SELECT id, y, is_test, {_NUMBER} AS j, x, coalesce(len(list_filter(es, lambda e: e <= x)), 0) AS bin, es FROM long LEFT JOIN el USING (feature)),
n0 AS (SELECT id, y, is_test, 0 AS node FROM zr)
"""
_GINI = "CASE WHEN {p} + {q} > 0 THEN 1 - ({p} / CAST({p} + {q} AS DOUBLE)) * ({p} / CAST({p} + {q} AS DOUBLE)) - ({q} / CAST({p} + {q} AS DOUBLE)) * ({q} / CAST({p} + {q} AS DOUBLE)) ELSE 0 END"


def _level(d: int) -> str:
    """CTEs h (histograms), g (gains), s (best splits) of depth d and the nodes n of the next one; children 2 node + 1 and + 2."""
    gini = lambda p, q: _GINI.format(p=f"({p})", q=f"({q})")
    return f""", c{d} AS (SELECT node, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS q FROM n{d} WHERE NOT is_test GROUP BY node),
h{d} AS (SELECT node, j, bin, count(*) FILTER (bl.y = 1) AS pos, count(*) FILTER (bl.y <> 1) AS neg FROM bl JOIN n{d} n USING (id) JOIN c{d} USING (node)
  WHERE NOT bl.is_test AND p + q >= 20 AND p > 0 AND q > 0 GROUP BY ALL),
a{d} AS (SELECT node, j, bin, CAST(sum(pos) OVER w AS BIGINT) AS lp, CAST(sum(neg) OVER w AS BIGINT) AS ln, CAST(sum(pos) OVER v AS BIGINT) AS p, CAST(sum(neg) OVER v AS BIGINT) AS q
  FROM h{d} WINDOW w AS (PARTITION BY node, j ORDER BY bin), v AS (PARTITION BY node, j)),
g{d} AS (SELECT node, j, bin, {gini('p', 'q')} - (lp + ln) / CAST(p + q AS DOUBLE) * {gini('lp', 'ln')} - (p + q - lp - ln) / CAST(p + q AS DOUBLE) * {gini('p - lp', 'q - ln')} AS gain
  FROM a{d} WHERE lp + ln >= 5 AND p + q - lp - ln >= 5),
s{d} AS MATERIALIZED (SELECT * FROM g{d} WHERE gain >= 1e-7 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, bin) = 1),
n{d + 1} AS MATERIALIZED (SELECT n.id, n.y, n.is_test, CASE WHEN s.node IS NULL THEN n.node WHEN bl.x <= bl.es[CAST(s.bin AS BIGINT) + 1] THEN 2 * n.node + 1 ELSE 2 * n.node + 2 END AS node
  FROM n{d} n LEFT JOIN s{d} s ON s.node = n.node LEFT JOIN bl ON bl.id = n.id AND bl.j = s.j)
"""


def _tree_sql(depth: int) -> str:
    return f"""{_BINNED}{''.join(map(_level, range(depth)))}, leaf AS (SELECT node, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS q FROM n{depth} WHERE NOT is_test GROUP BY node),
p AS (SELECT {', '.join(KEYS)}, zr.y, CASE WHEN leaf.p >= leaf.q THEN 1 ELSE -1 END AS pred FROM n{depth} n JOIN zr USING (id) JOIN leaf USING (node) WHERE zr.is_test)
"""


@query(_EDGES + "SELECT feature, CAST(b AS INTEGER) AS b, round(edge, 6) AS edge FROM edges")
def dt_edges(spark, sf_dir):
    train, _ = _prepared(spark, sf_dir)
    edges = tree.bin_edges(tree.blocks.packed(train, FEATURES), FEATURES)
    return spark.createDataFrame([(f, b, round(e, 6)) for f in FEATURES for b, e in enumerate(edges[f], 1)], "feature string, b int, edge double")


def _root(spark, sf_dir) -> DataFrame:
    train, _ = _prepared(spark, sf_dir)
    packed = tree.blocks.packed(train, FEATURES)
    return tree.histograms(tree.binned(packed, FEATURES, tree.bin_edges(packed, FEATURES)), FEATURES, [tree.Node(0, 0, 0)], [0])


@query(_BINNED + _level(0) + "SELECT CAST(j AS BIGINT) AS feature, CAST(bin AS BIGINT) AS bin, pos, neg FROM h0")
def dt_root_histogram(spark, sf_dir):
    return _root(spark, sf_dir).select("feature", "bin", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"))


@query(_BINNED + _level(0) + "SELECT CAST(j AS BIGINT) AS feature, CAST(bin AS BIGINT) AS bin, round(gain, 9) AS gain FROM g0")
def dt_root_gains(spark, sf_dir):
    return tree.gains(_root(spark, sf_dir), FEATURES, tree.gini_gains(tree.Params())).select("feature", "bin", F.round("gain", 9).alias("gain"))


@query(_BINNED + _level(0) + _level(1) + "SELECT CAST(node AS BIGINT) AS node, CAST(j AS BIGINT) AS feature, CAST(bin AS BIGINT) AS bin, round(gain, 9) AS gain FROM s0 UNION ALL SELECT CAST(node AS BIGINT), CAST(j AS BIGINT), CAST(bin AS BIGINT), round(gain, 9) FROM s1")
def dt_splits(spark, sf_dir):
    train, _ = _prepared(spark, sf_dir)
    model = tree.fit(train, FEATURES, tree.Params(max_depth=2))
    rows = [(i, n.feature, model.edges[FEATURES[n.feature]].index(n.threshold), round(n.gain, 9)) for i, n in enumerate(model.nodes) if n.feature >= 0]
    return spark.createDataFrame(rows, "node long, feature long, bin long, gain double")


@query(_tree_sql(6) + f"SELECT {', '.join(KEYS)}, y, pred FROM p")
def dt_predict(spark, sf_dir):
    train, test = _prepared(spark, sf_dir)
    return tree.fit(train, FEATURES, tree.Params(max_depth=6)).transform(test).select(*KEYS, "y", "pred")


@query(_tree_sql(12) + evaluate.METRICS_SQL)
def dt_metrics(spark, sf_dir):
    train, test = _prepared(spark, sf_dir)
    return evaluate.metrics(tree.fit(train, FEATURES).transform(test))


# --- exact and boosted trees ------------------------------------------------------------------------------------------------

_LONG = f"""{_Z}, zr AS (SELECT row_number() OVER () AS id, * FROM z),
long AS (UNPIVOT (SELECT id, y, is_test, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)} FROM zr) ON {', '.join(FEATURES)} INTO NAME feature VALUE x),
bl AS MATERIALIZED (SELECT id, y, is_test, {_NUMBER} AS j, x FROM long), n0 AS (SELECT id, y, is_test, 0 AS node FROM zr)
"""


def _exact_level(d: int) -> str:
    """The best cuts of depth d over all distinct values, and the nodes of the next one."""
    gini = lambda p, q: _GINI.format(p=f"({p})", q=f"({q})")
    return f""", h{d} AS (SELECT node, j, x, count(*) FILTER (bl.y = 1) AS pos, count(*) FILTER (bl.y <> 1) AS neg FROM bl JOIN n{d} n USING (id) WHERE NOT bl.is_test GROUP BY ALL),
a{d} AS (SELECT node, j, x, lead(x) OVER w AS nx, CAST(sum(pos) OVER w AS BIGINT) AS lp, CAST(sum(neg) OVER w AS BIGINT) AS ln, CAST(sum(pos) OVER v AS BIGINT) AS p, CAST(sum(neg) OVER v AS BIGINT) AS q
  FROM h{d} WINDOW w AS (PARTITION BY node, j ORDER BY x), v AS (PARTITION BY node, j)),
g{d} AS (SELECT node, j, (x + nx) * 0.5::DOUBLE AS cut, {gini('p', 'q')} - (lp + ln) / CAST(p + q AS DOUBLE) * {gini('lp', 'ln')} - (p + q - lp - ln) / CAST(p + q AS DOUBLE) * {gini('p - lp', 'q - ln')} AS gain
  FROM a{d} WHERE nx IS NOT NULL AND lp + ln >= 5 AND p + q - lp - ln >= 5 AND p + q >= 20 AND p > 0 AND q > 0),
s{d} AS MATERIALIZED (SELECT * FROM g{d} WHERE gain >= 1e-7 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, cut) = 1),
n{d + 1} AS MATERIALIZED (SELECT n.id, n.y, n.is_test, CASE WHEN s.node IS NULL THEN n.node WHEN bl.x <= s.cut THEN 2 * n.node + 1 ELSE 2 * n.node + 2 END AS node
  FROM n{d} n LEFT JOIN s{d} s ON s.node = n.node LEFT JOIN bl ON bl.id = n.id AND bl.j = s.j)
"""


_EXACT = f"""{_LONG}{''.join(map(_exact_level, range(3)))}, leaf AS (SELECT node, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS q FROM n3 WHERE NOT is_test GROUP BY node),
p AS (SELECT {', '.join(KEYS)}, zr.y, CASE WHEN leaf.p >= leaf.q THEN 1 ELSE -1 END AS pred FROM n3 n JOIN zr USING (id) JOIN leaf USING (node) WHERE zr.is_test)
"""


@query(_EXACT + f"SELECT {', '.join(KEYS)}, y, pred FROM p")
def exact_tree_predict(spark, sf_dir):
    train, test = _prepared(spark, sf_dir)
    return exact_tree.fit(train, FEATURES, tree.Params(max_depth=3)).transform(test).select(*KEYS, "y", "pred")


@query(_LONG + "".join(map(_exact_level, range(3))) + " UNION ALL ".join(f"SELECT {d} AS depth, CAST(j AS BIGINT) AS feature, round(cut, 6) AS threshold, round(gain, 9) AS gain FROM s{d}" for d in range(3)))
def exact_tree_cuts(spark, sf_dir):
    train, _ = _prepared(spark, sf_dir)
    nodes = exact_tree.fit(train, FEATURES, tree.Params(max_depth=3)).nodes
    return spark.createDataFrame([(n.depth, n.feature, round(n.threshold, 6), round(n.gain, 9)) for n in nodes if n.feature >= 0], "depth int, feature long, threshold double, gain double")


def _boosted_level(d: int) -> str:
    return f""", h{d} AS (SELECT node, j, bin, sum(CASE WHEN bl.y = 1 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END) AS g, count(*) * 0.25::DOUBLE AS h FROM bl JOIN n{d} n USING (id) WHERE NOT bl.is_test GROUP BY ALL),
a{d} AS (SELECT node, j, bin, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(g) OVER v AS g, sum(h) OVER v AS h FROM h{d} WINDOW w AS (PARTITION BY node, j ORDER BY bin), v AS (PARTITION BY node, j)),
g{d} AS (SELECT node, j, bin, lg * lg / lh + (g - lg) * (g - lg) / (h - lh) - g * g / h AS gain FROM a{d} WHERE lh >= 1 AND h - lh >= 1),
s{d} AS MATERIALIZED (SELECT * FROM g{d} WHERE gain >= 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, bin) = 1),
n{d + 1} AS MATERIALIZED (SELECT n.id, n.y, n.is_test, CASE WHEN s.node IS NULL THEN n.node WHEN bl.bin <= s.bin THEN 2 * n.node + 1 ELSE 2 * n.node + 2 END AS node
  FROM n{d} n LEFT JOIN s{d} s ON s.node = n.node LEFT JOIN bl ON bl.id = n.id AND bl.j = s.j)
"""


@query(f"""{_BINNED}{''.join(map(_boosted_level, range(3)))}, leaf AS (SELECT node, -sum(CASE WHEN y = 1 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END) / (count(*) * 0.25::DOUBLE) AS w FROM n3 WHERE NOT is_test GROUP BY node)
SELECT {', '.join(KEYS)}, zr.y, round(w, 9) AS margin, CASE WHEN w > 0 THEN 1 ELSE -1 END AS pred FROM n3 n JOIN zr USING (id) JOIN leaf USING (node) WHERE zr.is_test""")
def boosted_predict(spark, sf_dir):
    train, test = _prepared(spark, sf_dir)
    return boosted.fit(train, FEATURES, boosted.Params(max_depth=3)).transform(test).select(*KEYS, "y", F.round("margin", 9).alias("margin"), "pred")


# --- perceptron: small layers with fixed weights, so that SQL can follow --------------------------------------------------------

_HIDDEN = (4, 3)
_STEP = mlp.Params(epochs=2, lr=0.5, hidden=_HIDDEN)


def _fixed() -> mlp.Weights:
    w = mlp.initial(len(FEATURES), _STEP)
    return {n: np.round(np.sin(1.0 + k + 3.0 * np.arange(v.size)).reshape(v.shape) / 2, 4) for k, (n, v) in enumerate(w.items())}


def _names() -> list[tuple[str, str, tuple]]:
    """(name, layer, place) of every weight."""
    return [("_".join([n, *map(str, at)]), n, at) for n, v in _fixed().items() for at in np.ndindex(v.shape)]


def _forward_sql(source: str, w: str) -> str:
    """Columns h*, k* and z of rows x under the weights of the one row w."""
    first = ", ".join("greatest(" + " + ".join([*(f"{w}.w1_{i}_{j} * CAST(x.{f} AS DOUBLE)" for j, f in enumerate(FEATURES)), f"{w}.b1_{i}"]) + f", 0) AS h{i}" for i in range(_HIDDEN[0]))
    second = ", ".join("greatest(" + " + ".join([*(f"{w}.w2_{i}_{j} * h{j}" for j in range(_HIDDEN[0])), f"{w}.b2_{i}"]) + f", 0) AS k{i}" for i in range(_HIDDEN[1]))
    z = " + ".join([*(f"{w}.w3_0_{j} * k{j}" for j in range(_HIDDEN[1])), f"{w}.b3_0"])
    return f"(SELECT *, {z} AS z FROM (SELECT *, {second} FROM (SELECT x.*, {w}.*, {first} FROM {source} x, {w}) {w}) {w})"


def _start_sql() -> str:
    w = _fixed()
    return "w0 AS (SELECT " + ", ".join(f"{float(w[n][at])}::DOUBLE AS {name}, 0::DOUBLE AS v_{name}" for name, n, at in _names()) + ")"


def _step_sql(e: int, source: str = "tr", epoch: int | None = None) -> str:
    """w(e + 1) from w(e) by the gradient of all rows of a table."""
    up = {f"w3_0_{j}": f"dz * k{j}" for j in range(_HIDDEN[1])} | {"b3_0": "dz"}
    for i in range(_HIDDEN[1]):
        up |= {f"w2_{i}_{j}": f"e{i} * h{j}" for j in range(_HIDDEN[0])} | {f"b2_{i}": f"e{i}"}
    for i in range(_HIDDEN[0]):
        up |= {f"w1_{i}_{j}": f"d{i} * CAST({f} AS DOUBLE)" for j, f in enumerate(FEATURES)} | {f"b1_{i}": f"d{i}"}
    second = ", ".join(f"CASE WHEN k{i} > 0 THEN dz * w3_0_{i} ELSE 0 END AS e{i}" for i in range(_HIDDEN[1]))
    first = ", ".join(f"CASE WHEN h{i} > 0 THEN " + " + ".join(f"e{j} * w2_{j}_{i}" for j in range(_HIDDEN[1])) + f" ELSE 0 END AS d{i}" for i in range(_HIDDEN[0]))
    rows = f"(SELECT *, {first} FROM (SELECT *, {second} FROM (SELECT *, 1 / (1 + exp(-z)) - CASE WHEN y = 1 THEN 1 ELSE 0 END AS dz FROM {_forward_sql(source, f'w{e}')})))"
    speeds = ", ".join(f"{_STEP.momentum}::DOUBLE * any_value(v_{n}) + sum({g}) / count(*) AS v_{n}, any_value({n}) AS o_{n}" for n, g in up.items())
    rate = scalar.decayed(_STEP.lr, e if epoch is None else epoch)
    after = ", ".join(f"v_{n}, {1 - rate * _STEP.decay if n[0] == 'w' else 1.0!r}::DOUBLE * o_{n} - {rate!r}::DOUBLE * v_{n} AS {n}" for n in up)
    return f", w{e + 1} AS MATERIALIZED (SELECT {after} FROM (SELECT {speeds} FROM {rows}))"


@query(f"{_Z}, {_start_sql()}, te AS (SELECT * FROM z WHERE is_test) SELECT {', '.join(KEYS)}, y, round(z, 6) AS logit, CASE WHEN z >= 0 THEN 1 ELSE -1 END AS pred FROM {_forward_sql('te', 'w0')}")
def mlp_forward(spark, sf_dir):
    _, test = _prepared(spark, sf_dir)
    out = mlp.Model(FEATURES, _fixed(), []).transform(test)
    return out.select(*KEYS, "y", F.round("logit", 6).alias("logit"), "pred")


@query(f"{_Z}, {_start_sql()}, tr AS (SELECT * FROM z WHERE NOT is_test) SELECT round(avg(greatest(z, 0) - z * CASE WHEN y = 1 THEN 1 ELSE 0 END + ln(1 + exp(-abs(z)))), 6) AS loss FROM {_forward_sql('tr', 'w0')}")
def mlp_loss(spark, sf_dir):
    train, _ = _prepared(spark, sf_dir)
    return mlp.logits(train, FEATURES, _fixed()).agg(F.round(F.avg(scalar.bce(F.col("logit"), scalar.remapped(F.col("y")))), 6).alias("loss"))


@query(f"{_Z}, {_start_sql()}, tr AS (SELECT * FROM z WHERE NOT is_test){_step_sql(0)}{_step_sql(1)} " + " UNION ALL ".join(f"SELECT '{n}' AS weight, round({n}, 6) AS value FROM w2" for n, _, _ in _names()))
def mlp_full_steps(spark, sf_dir):
    train, _ = _prepared(spark, sf_dir)
    w = mlp.fit_full(train, FEATURES, _STEP, _fixed()).weights
    return spark.createDataFrame([(name, round(float(w[n][at]), 6)) for name, n, at in _names()], "weight string, value double")


_ORDER_KEYS = KEYS[:4]
_MD5 = "md5(concat_ws('|', '42', '{epoch}', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in _ORDER_KEYS) + "))"


@query(f"WITH {TASK_SQL}, r AS (SELECT {', '.join(KEYS)}, row_number() OVER (ORDER BY {_MD5.format(epoch=3)}, {', '.join(KEYS)}) AS rn, count(*) OVER () AS n FROM t) SELECT {', '.join(KEYS)}, CAST((rn - 1) // 128 AS BIGINT) AS batch FROM r WHERE (rn - 1) // 128 < n // 128")
def mlp_minibatches(spark, sf_dir):
    t = lineitem_task(spark, sf_dir).select(*KEYS)
    return ordering.minibatches(t, _ORDER_KEYS, epoch=3, ties=KEYS)


_WORKERS = 2
_BATCHED = f"""{_Z}, {_start_sql()}, r AS (SELECT *, row_number() OVER (ORDER BY {_MD5.format(epoch=0)}, {', '.join(KEYS)}) AS rn, {_WORKERS} * (count(*) OVER () // {2 * _WORKERS}) AS size FROM z WHERE NOT is_test),
s0 AS (SELECT * FROM r WHERE rn <= size), s1 AS (SELECT * FROM r WHERE rn > size AND rn <= 2 * size){_step_sql(0, 's0', 0)}{_step_sql(1, 's1', 0)} """


@query(_BATCHED + " UNION ALL ".join(f"SELECT '{n}' AS weight, round({n}, 6) AS value FROM w2" for n, _, _ in _names()))
def mlp_minibatch_steps(spark, sf_dir):
    """An epoch of two steps that two workers share, each with a quarter of the rows."""
    train, _ = _prepared(spark, sf_dir)
    params = mlp.Params(epochs=1, lr=_STEP.lr, hidden=_HIDDEN, batch=train.count() // (2 * _WORKERS), workers=_WORKERS)
    w = mlp.fit(train, FEATURES, _ORDER_KEYS, params, _fixed(), ties=KEYS).weights
    return spark.createDataFrame([(name, round(float(w[n][at]), 6)) for name, n, at in _names()], "weight string, value double")


@query(None)
def mlp_metrics(spark, sf_dir):
    """Minibatches on all rows of the embeddings task, whose vectors become columns."""
    wide = _wide(spark, sf_dir)
    return evaluate.metrics(mlp.fit(wide.where("not is_test"), _COMPONENTS, ["id"], mlp.Params(epochs=2)).transform(wide.where("is_test")))


# --- hinge loss, a step a row ---------------------------------------------------------------------------------------------------

_COMPONENTS = [f"f{i}" for i in range(64)]


def _wide(spark, sf_dir) -> DataFrame:
    """The embeddings task with a column for each component."""
    return embedding_task(spark, sf_dir).select("id", "y", "is_test", *(F.get("features", i).alias(f) for i, f in enumerate(_COMPONENTS)))


_SGD = hinge_sgd.Params(epochs=1)
_SGD_SQL = f"""WITH RECURSIVE e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y FROM embeddings),
r AS MATERIALIZED (SELECT v, y, row_number() OVER (ORDER BY md5(concat_ws('|', '{_SGD.seed}', '0', CAST(id AS VARCHAR))), id) AS i FROM e WHERE id % 5 <> 0),
m AS (SELECT 0::BIGINT AS i, list_transform(range(64), lambda x: 0::DOUBLE) AS w, 0::DOUBLE AS b
  UNION ALL SELECT r.i, list_transform(list_zip(m.w, r.v), lambda z: {1 - _SGD.lr * _SGD.decay!r}::DOUBLE * z[1] + CASE WHEN r.y * (list_dot_product(m.w, r.v) + m.b) < 1 THEN {_SGD.lr}::DOUBLE * r.y * z[2] ELSE 0 END),
    m.b + CASE WHEN r.y * (list_dot_product(m.w, r.v) + m.b) < 1 THEN {_SGD.lr}::DOUBLE * r.y ELSE 0 END FROM m JOIN r ON r.i = m.i + 1)
SELECT id, y, CASE WHEN list_dot_product(w, v) + b >= 0 THEN 1 ELSE -1 END AS pred FROM e, (SELECT w, b FROM m ORDER BY i DESC LIMIT 1) WHERE id % 5 = 0"""


@query(_SGD_SQL)
def hinge_sgd_predict(spark, sf_dir):
    """One pass over all training vectors, a step a row."""
    wide = _wide(spark, sf_dir)
    return hinge_sgd.fit(wide.where("not is_test"), _COMPONENTS, ["id"], _SGD).transform(wide.where("is_test")).select("id", "y", "pred")


# --- orders, encodings, summaries -------------------------------------------------------------------------------------------------


@query(f"WITH {TASK_SQL}, r AS (SELECT {', '.join(KEYS)}, row_number() OVER (ORDER BY {_MD5.format(epoch=0)}, {', '.join(KEYS)}) AS rn, count(*) OVER () AS n FROM t) SELECT {', '.join(KEYS)}, rn <= n * 80 // 100 AS is_train FROM r")
def split_80_20(spark, sf_dir):
    return ordering.split(lineitem_task(spark, sf_dir).select(*KEYS), _ORDER_KEYS, ties=KEYS)


def _lines(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@query(f"SELECT {', '.join(KEYS)}, " + ", ".join(f"CAST(l_returnflag = '{v}' AS INTEGER) AS flag_{v}" for v in "ANR") + " FROM lineitem")
def one_hot(spark, sf_dir):
    t = _lines(spark, sf_dir)
    values = encode.categories(t.where("l_orderkey % 5 <> 0"), "l_returnflag")
    return encode.one_hot(t.select(*KEYS, "l_returnflag"), "l_returnflag", values, "flag")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def label_encode(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return encode.label_encode(t, "o_orderpriority", encode.categories(t, "o_orderpriority"), "code").select("o_orderkey", "code")


@query("SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 END AS INTEGER) AS y FROM orders")
def label_map(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", scalar.mapped(F.col("o_orderstatus"), {"F": 1, "O": -1}).cast("int").alias("y"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(c: str) -> str:
    quartiles = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    return f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, {quartiles}, max({c}) AS max FROM lineitem"


@query(" UNION ALL ".join(map(_describe_sql, _MEASURES)))
def describe(spark, sf_dir):
    out = prep.describe(_lines(spark, sf_dir), _MEASURES)
    return out.select("feature", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", *(F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")), "max")


_CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query(" UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null FROM customer" for i, (c, t) in enumerate(_CUSTOMER)))
def column_info(spark, sf_dir):
    return prep.info(spark.read.parquet(f"{sf_dir}/customer.parquet"))


_TAX = [0.01, 0.03, 0.05, 0.07]


@query("SELECT CAST(len(list_filter([" + ", ".join(f"{e}::DOUBLE" for e in _TAX) + "], lambda e: e <= l_tax)) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY bin")
def bin_counts(spark, sf_dir):
    return _lines(spark, sf_dir).select(scalar.bin_of(F.col("l_tax"), _TAX).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT event_id, (value - 40) / 10 AS z, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS y, user_id FROM events)
SELECT event_id, round(1 / (1 + exp(-z)), 6) AS sigmoid, round(greatest(z, 0) - z * (y + 1) / 2 + ln(1 + exp(-abs(z))), 6) AS bce, round(greatest(z + 0.5, 0), 6) AS relu, CAST((y + 1) / 2 AS INTEGER) AS target,
  y AS label, round(1 - (user_id / (user_id + event_id + 1.0)) ** 2 - ((event_id + 1.0) / (user_id + event_id + 1.0)) ** 2, 6) AS gini, round(z * 8 + z, 6) AS total FROM x""")
def scalar_functions(spark, sf_dir):
    z, click = (F.col("value") - 40) / 10, F.when(F.col("event_type") == "click", 1).otherwise(-1)
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(
        "event_id", F.round(scalar.sigmoid(z), 6).alias("sigmoid"), F.round(scalar.bce(z, scalar.remapped(click)), 6).alias("bce"), F.round(scalar.relu(z, 0.5), 6).alias("relu"),
        scalar.remapped(click).alias("target"), scalar.signed(scalar.remapped(click)).alias("label"), F.round(scalar.gini(F.col("user_id"), F.col("event_id") + 1), 6).alias("gini"),
        F.round(scalar.total_ms(z * 8, z), 6).alias("total"),
    )


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS d, list_sum(list_transform(a.v, lambda x: x * x)) AS n, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)) AS f
  FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(d, 6) AS dot, round(n, 6) AS squared_norm, round(f, 6) AS distance FROM p""")
def vector_functions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    both = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select("vec_id", F.round(scalar.dot("a", "b"), 6).alias("dot"), F.round(scalar.squared_norm("a"), 6).alias("squared_norm"), F.round(scalar.squared_distance("a", "b"), 6).alias("distance"))


@query(r"""SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '^[^:]*:\s*([-+]?[0-9]+)', 1) AS DOUBLE), 0) AS k, coalesce(TRY_CAST(trim(event_type) AS DOUBLE), -1) AS kind,
  CAST(len(string_split(props, ':')) AS INTEGER) AS parts FROM events""")
def text_functions(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select("event_id", scalar.number_after_colon(F.col("props")).alias("k"), scalar.lenient_number(F.col("event_type"), -1).alias("kind"), F.size(scalar.fields(F.col("props"), ":")).alias("parts"))


@query("SELECT CAST(e AS INTEGER) AS epoch, round(0.01::DOUBLE / sqrt(e + 1), 9) AS lr FROM (SELECT unnest(range(30)) AS e)")
def learning_rates(spark, sf_dir):
    return spark.createDataFrame([(e, round(scalar.decayed(0.01, e), 9)) for e in range(30)], "epoch int, lr double")


