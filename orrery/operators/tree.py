"""Histogram decision trees, grown level by level: one job a level for the histograms of all open nodes.

Bins: a feature of at most ``bins`` distinct values has the midpoints between them as edges, another one the values at
floor(b / bins * n) of its sorted rows. A value's bin is the number of edges up to it. Tasks find each row's node and add up two
numbers a row (its class, or its derivatives) by node, feature and bin in numpy; Spark sums what they found. A level whose nodes
need a larger table than SLAB takes several jobs, each for some of its nodes. Small histograms are swept on the driver, larger
ones in tasks, a node each, by the same function; of equal gains the smaller feature, then the smaller edge is taken.

In the Gini tree rows go left where value <= edge, which for an edge that is a data value moves rows of this very value to the
left although their bin is the right one; node counts follow the rows, histograms the bins, as in the model that this tree has
to match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import blocks, order_keys

BINS = 64
#: Numbers in a task's table (two for each bin), and the most cells of a level that are swept on the driver.
SLAB, DRIVER_CELLS = 1 << 23, 1 << 18


@dataclass(frozen=True)
class Params:
    """max_depth (at least 1), rows of a node that is split, rows of a leaf, least gain, bins of a feature (2 to 256)."""

    max_depth: int = 12
    min_split: int = 20
    min_leaf: int = 5
    min_gain: float = 1e-7
    bins: int = BINS

    def __post_init__(self):
        object.__setattr__(self, "max_depth", max(self.max_depth, 1))
        if not 2 <= self.bins <= 256:
            raise ValueError("bins have to be 2 to 256")


@dataclass
class Node:
    """pos and neg: the sums over its rows, for the Gini tree the rows of both classes."""

    depth: int
    pos: int
    neg: int
    feature: int = -1
    threshold: float = 0.0
    gain: float = 0.0
    left: int = -1
    right: int = -1

    @property
    def prediction(self) -> int:
        return 1 if self.pos >= self.neg else -1


@dataclass
class Model:
    features: list[str]
    nodes: list[Node] = field(default_factory=list)
    edges: dict[str, list[float]] = field(default_factory=dict)

    def transform(self, rows: DataFrame) -> DataFrame:
        return predict(rows, self)


def bin_edges(packed: DataFrame, features: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """The edges of each feature of packed rows, in order; none for a constant feature."""
    found = order_keys.columns(packed, len(features), bins, lambda n: [b * n // bins for b in range(1, bins)])
    return {f: many or [(a + b) * 0.5 for a, b in zip(few, few[1:])] for f, (few, many) in zip(features, found)}


def walk(x: np.ndarray, nodes: list[Node]) -> np.ndarray:
    """The node that each row ends in."""
    feature = np.array([n.feature for n in nodes])
    threshold = np.array([n.threshold for n in nodes])
    left, right = np.array([n.left for n in nodes]), np.array([n.right for n in nodes])
    at = np.zeros(len(x), np.int64)
    for _ in range(max(n.depth for n in nodes) + 1):
        inner = feature[at] >= 0
        if not inner.any():
            break
        here = at[inner]
        goes = x[inner, feature[here]].astype(np.float64) <= threshold[here]
        at[inner] = np.where(goes, left[here], right[here])
    return at


def binned(rows: DataFrame, features: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """Packed rows with b: the bins of their values, feature by feature, a byte each."""
    cuts = [np.array(edges[f]) for f in features]

    def find(batches):
        for batch in batches:
            codes = []
            for n, x in zip(batch.column("n").to_pylist(), batch.column("x").to_pylist()):
                x = np.frombuffer(x, np.float32).reshape(n, -1)
                codes.append(np.stack([np.searchsorted(cut, x[:, j].astype(np.float64), side="right") for j, cut in enumerate(cuts)]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("n", "x", "y")), pa.array(codes, pa.binary())], names=["n", "x", "y", "b"])

    return rows.mapInArrow(find, "n long, x binary, y binary, b binary")


Pair = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def classes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of a row in the Gini tree."""
    return (y == 1).astype(float), (y != 1).astype(float)


def histograms(rows: DataFrame, features: list[str], nodes: list[Node], of: list[int], bins: int = BINS, pair: Pair = classes) -> DataFrame:
    """node, feature (number), bin and the sums pos and neg of ``pair``, of some nodes, from binned rows."""
    place = np.full(len(nodes), -1)
    place[of] = np.arange(len(of))
    k = len(features)

    def count(batches):
        total, seen = np.zeros((2, k, len(of) * bins)), np.zeros((k, len(of) * bins), bool)
        for batch in batches:
            for n, x, y, b in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y", "b"))):
                x = np.frombuffer(x, np.float32).reshape(n, -1)
                at = place[walk(x, nodes)]
                some = np.flatnonzero(at >= 0)
                base, numbers = at[some] * bins, pair(x[some], np.frombuffer(y, np.int8)[some])
                codes = np.frombuffer(b, np.uint8).reshape(k, n)
                for j in range(k):
                    at = base + codes[j][some]
                    seen[j][at] = True
                    for i in (0, 1):
                        total[i, j] += np.bincount(at, weights=numbers[i], minlength=total.shape[2])
        j, at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(of, np.int64)[at // bins]), pa.array(j), pa.array(at % bins), *(pa.array(total[i, j, at]) for i in (0, 1))], names=["node", "feature", "bin", "pos", "neg"])

    found = rows.mapInArrow(count, "node long, feature long, bin long, pos double, neg double")
    return found.groupBy("node", "feature", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _gini(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    n = np.maximum(p + q, 1)
    return np.where(p + q > 0, 1 - (p / n) * (p / n) - (q / n) * (q / n), 0.0)


def cut_gains(lp: np.ndarray, ln: np.ndarray, p: np.ndarray, q: np.ndarray, params: Params) -> np.ndarray:
    """The gain of cuts with lp and ln rows of both classes on the left, in nodes of p and q (NaN: a side, or the node, is too small, or pure)."""
    left, n = lp + ln, p + q
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = _gini(p, q) - left / n * _gini(lp, ln) - (n - left) / n * _gini(p - lp, q - ln)
    good = (left >= params.min_leaf) & (n - left >= params.min_leaf) & (n >= params.min_split) & (p > 0) & (q > 0)
    return np.where(good, gain, np.nan)


def gini_gains(params: Params) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The gain of a split behind each bin (NaN: not allowed) from sums of shape (features, bins)."""

    def gains(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        lp, ln = pos.cumsum(axis=1), neg.cumsum(axis=1)
        return cut_gains(lp, ln, lp[:, -1:], ln[:, -1:], params)

    return gains


def _table(found: pa.Table | pa.RecordBatch, k: int, bins: int) -> dict[int, np.ndarray]:
    """For each node its sums, (2, features, bins)."""
    node, j, b, pos, neg = (found.column(c).to_numpy() for c in ("node", "feature", "bin", "pos", "neg"))
    names, at = np.unique(node, return_inverse=True)
    sums = np.zeros((len(names), 2, k, bins))
    sums[at, 0, j, b], sums[at, 1, j, b] = pos, neg
    return dict(zip(names.tolist(), sums))


def gains(hist: DataFrame, features: list[str], of: Callable, bins: int = BINS) -> DataFrame:
    """node, feature, bin, gain of every split of the histograms that is allowed; a node is one group of at most features x bins rows."""
    k = len(features)

    def sweep(found: pa.Table) -> pa.Table:
        ((node, sums),) = _table(found, k, bins).items()
        gain = of(*sums)
        there = np.zeros(gain.shape, bool)
        there[found.column("feature").to_numpy(), found.column("bin").to_numpy()] = True
        j, b = np.nonzero(there & ~np.isnan(gain))
        return pa.table({"node": np.full(len(j), node), "feature": j, "bin": b, "gain": gain[j, b]})

    return hist.groupBy("node").applyInArrow(sweep, "node long, feature long, bin long, gain double")


def _best(sums: np.ndarray, of: Callable, last: np.ndarray, least: float) -> tuple[float, float, int, int, float]:
    """(pos, neg, feature, bin, gain) of a node; feature -1: no split. last: the number of edges of each feature."""
    gain = of(*sums)
    gain[np.arange(gain.shape[1])[None, :] >= last[:, None]] = np.nan
    gain = np.where(gain >= least, gain, -np.inf)
    at = int(gain.argmax())  # the first one of equal gains
    j, b = divmod(at, gain.shape[1])
    pos, neg = sums[:, 0].sum(axis=1)
    return float(pos), float(neg), j if gain[j, b] > -np.inf else -1, b, float(gain[j, b])


def best_splits(hist: DataFrame, features: list[str], of: Callable, last: np.ndarray, least: float, bins: int, cells: int) -> list[tuple]:
    """(node, pos, neg, feature, bin, gain) of every node."""
    k = len(features)
    if cells <= DRIVER_CELLS:
        return [(node, *_best(sums, of, last, least)) for node, sums in _table(hist.toArrow(), k, bins).items()]

    def sweep(found: pa.Table) -> pa.Table:
        ((node, sums),) = _table(found, k, bins).items()
        return pa.table([[x] for x in (node, *_best(sums, of, last, least))], names=["node", "pos", "neg", "feature", "bin", "gain"])

    return [tuple(r) for r in hist.groupBy("node").applyInArrow(sweep, "node long, pos double, neg double, feature long, bin long, gain double").collect()]  # a row a node


def grown(rows: DataFrame, features: list[str], edges: dict[str, list[float]], params, of: Callable, pair: Pair, strict: bool = False) -> list[Node]:
    """The nodes of the tree of binned rows; ``of``: gains; strict: rows of an edge's value go right."""
    nodes, level = [Node(0, 0, 0)], [0]
    last = np.array([len(edges[f]) for f in features])
    slab = max(1, SLAB // (2 * max(1, len(features)) * params.bins))
    while level and features:
        best = []
        for at in range(0, len(level), slab):
            some = level[at : at + slab]
            best += best_splits(histograms(rows, features, nodes, some, params.bins, pair), features, of, last, params.min_gain, params.bins, len(some) * len(features) * params.bins)
        deepest = nodes[level[0]].depth >= params.max_depth
        level = []
        for at, pos, neg, j, b, gain in sorted(best):
            node = nodes[at]
            node.pos, node.neg = pos, neg
            if j >= 0 and not deepest:
                edge = edges[features[j]][b]
                node.feature, node.gain, node.threshold = j, gain, float(np.nextafter(edge, -np.inf)) if strict else edge
                node.left, node.right = len(nodes), len(nodes) + 1
                nodes += [Node(node.depth + 1, 0, 0), Node(node.depth + 1, 0, 0)]
                level += [node.left, node.right]
    return nodes


def fit(train: DataFrame, features: list[str], params: Params = Params()) -> Model:
    """The Gini tree of complete rows (features float, y); without rows or features one leaf."""
    packed = blocks.packed(train, features).persist()
    try:
        edges = bin_edges(packed, features, params.bins)
        rows = binned(packed, features, edges).persist()
        try:
            return Model(features, grown(rows, features, edges, params, gini_gains(params), classes), edges)
        finally:
            rows.unpersist()
    finally:
        packed.unpersist()


def leaf_of(nodes: list[Node], features: list[str]) -> Column:
    """The number of the leaf that a row ends in; null where a feature is null or NaN.

    The nodes are constant arrays and a row takes a step a level through them, so the expression is as large for any tree.
    """
    constant = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    feature, threshold = constant([n.feature for n in nodes], "int"), constant([float(n.threshold) for n in nodes], "double")
    left, right = constant([n.left for n in nodes], "int"), constant([n.right for n in nodes], "int")
    depth = max(n.depth for n in nodes)
    if depth == 0:
        found = lambda x: F.lit(0)
    else:
        step = lambda x: lambda at, _: F.when(F.get(feature, at) < 0, at).when(F.get(x, F.get(feature, at)) <= F.get(threshold, at), F.get(left, at)).otherwise(F.get(right, at))
        found = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step(x))
    values = [F.col(f).cast("float").cast("double") for f in features]
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull() & ~F.isnan(v)
    # bound once for all steps of a row
    return F.when(known, F.get(F.transform(F.array(F.array(*values)), found), 0))


def of_leaves(nodes: list[Node], features: list[str], values: list, kind: str) -> Column:
    """The value of the leaf that a row ends in."""
    return F.get(F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>"), leaf_of(nodes, features))


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """rows with pred; null where a feature is null."""
    return rows.withColumn("pred", of_leaves(model.nodes, model.features, [n.prediction for n in model.nodes], "int"))
