"""Gini tree over all distinct values: no bins, each cut lies midway between two values of a node that follow each other.

Every feature is cut into ranges once. A value is a range of its own if its feature has at most FEW values, or if it has about
RANGE rows or more; other values share ranges of about RANGE rows, and the rows of such a range are dealt to one place and sorted
by the feature, once for all levels. On each level tasks add up the classes and the least and greatest value of (node, feature,
range). From these sums follow the gains of the cuts between ranges, and what comes before a range; with that, the sorted rows are
run through for the cuts inside the ranges. What is shuffled a level are sums of ranges, never values, and no task holds all
rows of a feature. Of equal gains the smaller feature, then the smaller value is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import blocks, order_keys, tree

#: Rows and bytes of a range that several values share, and the most values of a feature whose values are ranges each.
RANGE, BYTES, FEW = 500_000, 1 << 26, 256


@dataclass
class Ranges:
    """The ranges of all features, numbered through; ``runs`` has the numbers of those that several values share."""

    cuts: list[np.ndarray]  # for each feature the first values of its ranges but the first one
    first: np.ndarray  # the number of each feature's first range, and how many ranges there are
    runs: np.ndarray

    def of(self, j: int, x: np.ndarray) -> np.ndarray:
        return self.first[j] + np.searchsorted(self.cuts[j], x.astype(np.float64), side="right")

    @property
    def n(self) -> int:
        return int(self.first[-1])

    def feature(self, number: int) -> int:
        return int(np.searchsorted(self.first, number, side="right")) - 1


def ranges_of(packed: DataFrame, features: int, size: int, few: int) -> Ranges:
    """A value is in one range alone; one at which two positions or more meet, ``size`` rows apart, has no other value beside it."""
    cuts, shared = [], []
    for values, many in order_keys.columns(packed, features, few, lambda n: list(range(size, n, size))):
        many = np.array(many, np.float64)
        heavy = np.unique(many[1:][many[1:] == many[:-1]])
        after = order_keys.values_of(order_keys.keys_of(heavy) + np.uint32(1))
        cuts.append(np.array(values[1:], np.float64) if values else np.unique(np.concatenate([many, after])))
        shared.append(np.concatenate([[True], ~np.isin(cuts[-1], heavy)]) & (not values))
    return Ranges(cuts, np.concatenate([[0], np.cumsum([len(s) for s in shared])]).astype(np.int64), np.flatnonzero(np.concatenate(shared)))


def coded(packed: DataFrame, ranges: Ranges) -> DataFrame:
    """Packed rows with r: the numbers of their ranges, feature by feature."""
    kind = np.min_scalar_type(ranges.n)

    def find(batches):
        for batch in batches:
            codes = []
            for n, x in zip(batch.column("n").to_pylist(), batch.column("x").to_pylist()):
                x = np.frombuffer(x, np.float32).reshape(n, -1)
                codes.append(np.stack([ranges.of(j, x[:, j]) for j in range(len(ranges.cuts))]).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("n", "x", "y")), pa.array(codes, pa.binary())], names=["n", "x", "y", "r"])

    return packed.mapInArrow(find, "n long, x binary, y binary, r binary")


def sorted_runs(packed: DataFrame, ranges: Ranges) -> DataFrame:
    """run, n, x, y: a row for each shared range that has rows, sorted by its feature; ``run`` is the place of its number in ranges.runs."""
    run_of = np.full(ranges.n, -1)
    run_of[ranges.runs] = np.arange(len(ranges.runs))
    some = sorted({ranges.feature(number) for number in ranges.runs.tolist()})
    features = [ranges.feature(number) for number in ranges.runs.tolist()]
    names, schema = ["run", "n", "x", "y"], "run int, n long, x binary, y binary"

    def deal(batches):
        for x, y in blocks.unpacked(batches):
            for j in some:
                run = run_of[ranges.of(j, x[:, j])]
                order = np.argsort(run, kind="stable")
                parts = [p for p in np.split(order, np.flatnonzero(np.diff(run[order])) + 1) if len(p) and run[p[0]] >= 0]
                told = [(int(run[p[0]]), len(p), x[p].tobytes(), y[p].tobytes()) for p in parts]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)

    def whole(run: int, parts: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        n = sum(p[0] for p in parts)
        x, y = np.frombuffer(b"".join(p[1] for p in parts), np.float32).reshape(n, -1), np.frombuffer(b"".join(p[2] for p in parts), np.int8)
        order = np.argsort(x[:, features[run]], kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([n]), pa.array([x[order].tobytes()]), pa.array([y[order].tobytes()])], names=names)

    def join(batches):
        now, parts = -1, []
        for batch in batches:
            for run, *part in zip(*(batch.column(c).to_pylist() for c in names)):
                if run != now and parts:
                    yield whole(now, parts)
                    parts = []
                now = run
                parts.append(part)
        if parts:
            yield whole(now, parts)

    return packed.mapInArrow(deal, schema).repartitionById(len(ranges.runs), F.col("run")).sortWithinPartitions("run").mapInArrow(join, schema)


def sums(rows: DataFrame, ranges: Ranges, nodes: list[tree.Node], of: list[int]) -> np.ndarray:
    """pos, neg, least and greatest value of every range in some nodes, from coded rows: shape (4, nodes, ranges)."""
    place = np.full(len(nodes), -1)
    place[of] = np.arange(len(of))
    size, k = ranges.n, len(ranges.cuts)
    kind = np.min_scalar_type(size)
    mixed = {ranges.feature(number) for number in ranges.runs.tolist()}

    def count(batches):
        n, low, high = np.zeros((2, len(of) * size), np.int64), np.full(len(of) * size, np.inf), np.full(len(of) * size, -np.inf)
        for batch in batches:
            for m, x, y, r in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y", "r"))):
                x, codes = np.frombuffer(x, np.float32).reshape(m, -1), np.frombuffer(r, kind).reshape(k, m)
                at = place[tree.walk(x, nodes)]
                some = np.flatnonzero(at >= 0)
                base, pos = at[some] * size, np.frombuffer(y, np.int8)[some] == 1
                for j in range(k):
                    cell, v = base + codes[j][some], x[some, j].astype(np.float64) + 0.0
                    for i, chosen in enumerate((pos, ~pos)):
                        n[i] += np.bincount(cell[chosen], minlength=n.shape[1])
                    if j in mixed:
                        np.minimum.at(low, cell, v)
                        np.maximum.at(high, cell, v)
                    else:
                        low[cell] = high[cell] = v
        at = np.flatnonzero(n[0] + n[1])
        yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (np.arange(n.shape[1]), n[0], n[1], low, high)], names=["cell", "pos", "neg", "low", "high"])

    found = rows.mapInArrow(count, "cell long, pos long, neg long, low double, high double").groupBy("cell")
    table = found.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()  # at most nodes x ranges rows
    out = np.zeros((4, len(of) * size))
    out[2], out[3] = np.inf, -np.inf
    for i, c in enumerate(("pos", "neg", "low", "high")):
        out[i, table.column("cell").to_numpy()] = table.column(c).to_numpy()
    return out.reshape(4, len(of), size)


#: gain, feature, threshold of a cut; better ones have the larger key.
Cut = tuple[float, int, float]


def key(cut: Cut) -> Cut:
    return cut[0], -cut[1], -cut[2]


def between(found: np.ndarray, ranges: Ranges, params: tree.Params) -> list[Cut | None]:
    """The best cut between two ranges of each node."""
    out: list[Cut | None] = [None] * found.shape[1]
    for j in range(len(ranges.cuts)):
        pos, neg, low, high = found[:, :, ranges.first[j] : ranges.first[j + 1]]
        lp, lq = pos.cumsum(axis=1), neg.cumsum(axis=1)
        follows = np.minimum.accumulate(low[:, ::-1], axis=1)[:, -2::-1]  # the least value behind each range but the last one
        gain = tree.cut_gains(lp, lq, lp[:, -1:], lq[:, -1:], params)[:, :-1]
        gain = np.where((pos + neg > 0)[:, :-1] & np.isfinite(follows) & (gain >= params.min_gain), gain, -np.inf)
        if not gain.shape[1]:
            continue
        for at, r in enumerate(gain.argmax(axis=1)):  # the first one of equal gains
            if gain[at, r] > -np.inf:
                cut = float(gain[at, r]), j, float((high[at, r] + follows[at, r]) * 0.5) + 0.0
                out[at] = max(out[at] or cut, cut, key=key)
    return out


def inside(runs: DataFrame, found: np.ndarray, ranges: Ranges, nodes: list[tree.Node], of: list[int], params: tree.Params) -> dict[int, Cut]:
    """The best cut inside a range of those nodes that may have one."""
    p, q = found[:2, :, : ranges.first[1]].sum(axis=2)
    open_ = (p > 0) & (q > 0) & (p + q >= params.min_split)
    if not open_.any():
        return {}
    place = np.full(len(nodes), -1)
    place[np.array(of)[open_]] = np.flatnonzero(open_)
    features = [ranges.feature(number) for number in ranges.runs.tolist()]
    start = ranges.first[features]
    upto = np.concatenate([np.zeros((2, len(of), 1)), found[:2].cumsum(axis=2)], axis=2)
    bp, bq = upto[:, :, ranges.runs] - upto[:, :, start]  # the node's rows before each run

    def look(batches):
        for batch in batches:
            for run, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("run", "n", "x", "y"))):
                x, j = np.frombuffer(x, np.float32).reshape(n, -1), features[run]
                at = place[tree.walk(x, nodes)]
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0) :]  # node by node, by value in each
                at, v, pos = at[order], x[order, j].astype(np.float64), np.frombuffer(y, np.int8)[order] == 1
                begin = np.flatnonzero(np.diff(at, prepend=-1))
                back = np.repeat(begin, np.diff(begin, append=len(at)))
                upto = np.concatenate([[0], pos.cumsum()])
                cut = np.flatnonzero((at[1:] == at[:-1]) & (v[1:] != v[:-1]))
                node, lp = at[cut], upto[cut + 1] - upto[back[cut]]
                lq = cut + 1 - back[cut] - lp
                gain = tree.cut_gains(lp + bp[node, run], lq + bq[node, run], p[node], q[node], params)
                good = gain >= params.min_gain
                node, cut, gain = node[good], cut[good], gain[good]
                if not len(node):
                    continue
                first = np.flatnonzero(np.diff(node, prepend=-1))
                top = np.repeat(np.maximum.reduceat(gain, first), np.diff(first, append=len(node)))
                best = np.flatnonzero(gain == top)
                best = best[np.flatnonzero(np.diff(node[best], prepend=-1))]  # the first one of equal gains
                c = cut[best]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (node[best], gain[best], np.full(len(c), -j), -((v[c] + v[c + 1]) * 0.5))], names=["node", "gain", "f", "t"])

    best = runs.mapInArrow(look, "node long, gain double, f long, t double").groupBy("node").agg(F.max(F.struct("gain", "f", "t")).alias("best")).collect()  # a row a node
    return {r["node"]: (r["best"]["gain"], -r["best"]["f"], -r["best"]["t"] + 0.0) for r in best}


def fit(train: DataFrame, features: list[str], params: tree.Params = tree.Params(), *, range_rows: int = RANGE, few: int = FEW) -> tree.Model:
    """The tree of complete rows (features float, y); without rows or features one leaf."""
    nodes, level = [tree.Node(0, 0, 0)], [0]
    if not features:
        return tree.Model(features, nodes)
    packed = blocks.packed(train, features).persist()
    kept = [packed]
    try:
        ranges = ranges_of(packed, len(features), max(1, min(range_rows, BYTES // (4 * len(features) + 1))), few)
        rows = coded(packed, ranges).persist()
        runs = sorted_runs(packed, ranges).persist() if len(ranges.runs) else None
        kept += [rows, *([runs] if runs is not None else [])]
        slab = max(1, tree.DRIVER_CELLS // ranges.n)
        while level:
            deepest = nodes[level[0]].depth >= params.max_depth
            told = []
            for at in range(0, len(level), slab):
                some = level[at : at + slab]
                found = sums(rows, ranges, nodes, some)
                best = between(found, ranges, params)
                for i, cut in (inside(runs, found, ranges, nodes, some, params) if runs is not None and not deepest else {}).items():
                    best[i] = max(best[i] or cut, cut, key=key)
                told += zip(some, found[:2, :, : ranges.first[1]].sum(axis=2).T, best)
            level = []
            for number, (pos, neg), cut in told:
                node = nodes[number]
                node.pos, node.neg = int(pos), int(neg)
                if cut is not None and not deepest:
                    node.gain, node.feature, node.threshold = cut
                    node.left, node.right = len(nodes), len(nodes) + 1
                    nodes += [tree.Node(node.depth + 1, 0, 0), tree.Node(node.depth + 1, 0, 0)]
                    level += [node.left, node.right]
    finally:
        for df in kept:
            df.unpersist()
    return tree.Model(features, nodes)
