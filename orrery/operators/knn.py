"""Exact k nearest neighbours: queries look up the shells of training rows that may hold nearer rows, in files in the shared folder.

A k-d tree, fitted to the vectors of a bounded sample, deals all rows to cells. Training rows are dealt to ranges of (cell, vector,
id) and written as shells, up to some thousand rows of one cell each; a directory holds the box of every shell and its least and
greatest distance from one of PIVOTS rows. Queries are dealt in the same order, so the ones that a task meets together lie close
to each other. They read the shells around them first, then those that neither their boxes nor the triangle inequality put past
the k-th distance so far. A task finds all k neighbours of its queries; it holds up to about HELD bytes of shells, and reads on
from the files what else it needs, so neither side has to fit into memory. Of equal vectors, those of the k smallest ids are kept in the
shells, since no others can be neighbours, and equal queries are looked up once. Distances come from ||q||^2 + ||t||^2 - 2 q.t by a
matrix product; the candidates that it leaves are measured again by sums of squared differences, so equal rows have equal distances;
ties go to the smaller id.

Rows with a null or non-finite component, or of another length than the most frequent one, are no neighbours; such queries
have none and are predicted -1.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery import storage

#: Rows of a shell, if these aren't more than MOST shells; rows with which triangles are made; rows that the cells are fitted to;
#: bytes of shells that a task keeps.
CHUNK, MOST, PIVOTS, SAMPLE, HELD = 1024, 1 << 16, 256, 1 << 15, 1 << 26


@dataclass(frozen=True)
class Params:
    """k, and block, the queries compared at a time (no result depends on it), each at least 1."""

    k: int = 11
    block: int = 256

    def __post_init__(self):
        for name in ("k", "block"):
            object.__setattr__(self, name, max(getattr(self, name), 1))


def squared_norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _usable(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return df.withColumn(vector, v).where((F.size(vector) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def sample_of(known: DataFrame, key: str, vector: str) -> list[list[float]]:
    """Up to SAMPLE training vectors, those of the smallest hashes of their keys."""
    return known.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toArrow().column(0).to_pylist()


class Cells:
    """A k-d tree over a sample, halved at its widest component down to ``least`` rows; cells are numbered from left to right."""

    def __init__(self, sample: np.ndarray, least: int):
        self.nodes: list[list] = []  # component, value, left, right (~cell: a cell)
        self.cells = 0
        self.root = self._grow(sample, max(least, 1))

    def _grow(self, x: np.ndarray, least: int) -> int:
        wide = np.ptp(x, axis=0) if len(x) > least and x.shape[1] else np.zeros(1)
        j = int(wide.argmax())
        if not wide[j] > 0:
            self.cells += 1
            return ~(self.cells - 1)
        v = np.sort(x[:, j])
        cut = v[len(v) // 2]
        if cut == v[0]:
            cut = v[np.searchsorted(v, cut, side="right")]
        node = len(self.nodes)
        self.nodes.append([j, cut, 0, 0])
        low = x[:, j] < cut
        self.nodes[node][2], self.nodes[node][3] = self._grow(x[low], least), self._grow(x[~low], least)
        return node

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.full(len(x), self.root)
        if self.nodes:
            j, cut, left, right = (np.array(c) for c in zip(*self.nodes))
            open_ = np.flatnonzero(at >= 0)
            while len(open_):
                n = at[open_]
                at[open_] = np.where(x[open_, j[n]] < cut[n], left[n], right[n])
                open_ = open_[at[open_] >= 0]
        return ~at


@dataclass
class Shell:
    """Rows of one pivot whose distances from it lie between near and far."""

    pivot: int
    near: float
    far: float
    ids: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def __post_init__(self):
        self.low, self.high = self.x.min(axis=0), self.x.max(axis=0)


def gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Distances between a box (low, high) and boxes, a row each; a point is a box too."""
    return np.sqrt((np.maximum(np.maximum(lows - high, low - highs), 0) ** 2).sum(axis=1))


class Best:
    """The k nearest rows so far of a block of queries; ``compared`` counts the distances that were measured."""

    def __init__(self, q: np.ndarray, k: int, pivots: np.ndarray):
        self.q, self.k, self.compared = q, k, 0
        self.d, self.ids, self.y = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max), np.zeros((len(q), k), np.int32)
        square = squared_norms(q)[:, None] + squared_norms(pivots)[None, :] - 2 * (q @ pivots.T)
        self.slack = 1e-7 * (1 + np.sqrt(square.max(initial=0)))
        self.to_pivots = np.sqrt(np.maximum(square, 0))
        # pivots are rows, so the k-th nearest of them is no nearer than the k-th nearest row
        self.most = np.partition(self.to_pivots, k - 1, axis=1)[:, k - 1] if len(pivots) >= k else np.full(len(q), np.inf)

    def kth(self) -> np.ndarray:
        """No k-th distance of a query is above these."""
        return np.minimum(np.sqrt(self.d[:, -1]), self.most + self.slack)

    def bounds(self, shell: Shell) -> np.ndarray:
        """Below every distance of a query to the shell's rows, by its box and the triangle inequality."""
        to = self.to_pivots[:, shell.pivot]
        return np.maximum(np.maximum(to - shell.far, shell.near - to), gaps(shell.low, shell.high, self.q, self.q)) - self.slack

    def visit(self, shells: list[Shell]) -> None:
        """Nearest shells first; a shell is skipped for the queries whose k-th distance is below its bound."""
        bounds = [self.bounds(s) for s in shells]
        for i in sorted(range(len(shells)), key=lambda i: bounds[i].mean()):
            who = np.flatnonzero(bounds[i] <= self.kth())
            if len(who):
                self._add(shells[i], who)

    def _add(self, shell: Shell, who: np.ndarray) -> None:
        self.compared += len(who) * len(shell.ids)
        q, x, k = self.q[who], shell.x, self.k
        qn, xn = squared_norms(q), squared_norms(x)
        rough = qn[:, None] + xn[None, :] - 2 * (q @ x.T)
        limit = self.kth()[who] ** 2
        open_ = np.flatnonzero(np.isinf(self.d[who, -1]))
        if len(open_) and len(x) > k:
            limit[open_] = np.minimum(limit[open_], np.partition(rough[open_], k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero(rough <= (limit + 1e-9 * (qn + xn.max() + 1))[:, None])
        if not len(r):
            return
        far = ((q[r] - x[c]) ** 2).sum(axis=1)
        some, r = np.unique(r, return_inverse=True)
        at = who[some]
        row = np.concatenate([np.repeat(np.arange(len(at)), k), r])
        every = [np.concatenate([old[at].ravel(), new]) for old, new in ((self.d, far), (self.ids, shell.ids[c]), (self.y, shell.y[c]))]
        order = np.lexsort((every[1], every[0], row))
        first = order[np.searchsorted(row[order], np.arange(len(at)))[:, None] + np.arange(k)]  # every row has k or more
        self.d[at], self.ids[at], self.y[at] = (e[first] for e in every)


@dataclass
class Directory:
    """Where the shells of all training rows lie, and their bounds."""

    places: list[tuple[str, int, int]]  # file, offset, rows
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def read(self, i: int, width: int) -> Shell:
        name, offset, n = self.places[i]
        system, place = storage.open_fs(name)
        with system.open_input_file(place) as file:
            raw = file.read_at(n * (12 + 8 * width), offset)
        ids, y, x = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int32, n, 8 * n), np.frombuffer(raw, np.float64, n * width, 12 * n)
        return Shell(int(self.pivot[i]), self.near[i], self.far[i], ids, x.reshape(n, width), y)


class Reader:
    """Shells of a directory; up to about HELD bytes of those that were asked for last are kept."""

    def __init__(self, directory: Directory, width: int):
        self.directory, self.width, self.held, self.bytes = directory, width, OrderedDict(), 0

    def __call__(self, i: int) -> Shell:
        if i in self.held:
            self.held.move_to_end(i)
            return self.held[i]
        shell = self.held[i] = self.directory.read(i, self.width)
        self.bytes += shell.x.nbytes
        while self.bytes > HELD and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1].x.nbytes
        return shell


def look_up(q: np.ndarray, k: int, size: int, pivots: np.ndarray, shells: Reader) -> list[Best]:
    """The k nearest rows of queries that lie close to each other where they follow each other, ``size`` at a time."""
    d = shells.directory
    found = [Best(q[at : at + size], k, pivots) for at in range(0, len(q), size)]
    wanted: dict[int, list[Best]] = {}
    for best in found:
        gap = gaps(best.q.min(axis=0), best.q.max(axis=0), d.low, d.high) - best.slack
        order = np.argsort(gap, kind="stable")
        near = int((gap <= 0).sum())
        best.visit([shells(i) for i in order[:near]])
        while near < len(order) and np.isinf(best.d[:, -1]).any() and gap[order[near]] <= best.kth().max():
            best.visit([shells(order[near])])
            near += 1
        for i in order[near:][gap[order[near:]] <= best.kth().max()].tolist():
            wanted.setdefault(i, []).append(best)
    for i in sorted(wanted):  # read once for all queries
        some = [best for best in wanted[i] if gaps(best.q.min(axis=0), best.q.max(axis=0), d.low[i : i + 1], d.high[i : i + 1])[0] - best.slack <= best.kth().max()]
        for best in some:
            best.visit([shells(i)])
    return found


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]))[: len(x)]


def neighbours(train: DataFrame, queries: DataFrame, k: int = 11, *, key: str = "id", vector: str = "features", label: str = "y", block: int = Params.block) -> DataFrame:
    """query, rank (from 1), neighbour, distance (squared), y of the min(k, rows) nearest training rows of every query; a task meets
    block queries at a time."""
    k, size = max(k, 1), max(block, 1)
    spark = train.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    known = _usable(train.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("int").alias("y")).where(F.col(key).isNotNull() & F.col(label).isNotNull()), "v")
    sizes = known.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width, n = sizes if sizes else (0, 0)
    known = known.where(F.size("v") == width)
    asked = _usable(queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col(key).isNotNull()), "v").where(F.size("v") == width)
    sample = np.array(sample := sample_of(known, "id", "v"), np.float64).reshape(len(sample), width)
    rows = max(CHUNK, -(-n // MOST))
    cells, pivots = Cells(sample, max(16, len(sample) * rows // (2 * max(n, 1)))), sample[:PIVOTS]
    path = storage.shared_path(spark, "shells")

    def rows_of(batch) -> np.ndarray:
        return np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, width)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(rows_of(batch)))], names=[*batch.schema.names, "cell"])

    def dealt(df: DataFrame) -> DataFrame:
        """Rows of a cell stand together, and equal vectors in it; more of them than a task should hold are in several tasks."""
        found = df.mapInArrow(deal, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", cell long")
        return found.repartitionByRange(parts, "cell", "v", "id").sortWithinPartitions("cell", "v", "id")

    def store(batches):
        name, offset, out = f"{path}/{uuid.uuid4().hex}", 0, None
        system, place = storage.open_fs(name)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
            x, cell = rows_of(batch), batch.column("cell").to_numpy()
            begin = runs_of(x)
            kept = np.flatnonzero(np.arange(len(x)) - np.repeat(begin, np.diff([*begin, len(x)])) < k)  # of equal vectors the first k ids
            told = []
            for run in np.split(kept, np.flatnonzero(np.diff(cell[kept])) + 1):
                for part in np.array_split(run, -(-len(run) // rows)):
                    v, ids, y = x[part], batch.column("id").to_numpy()[part], batch.column("y").to_numpy()[part]
                    pivot = int(((pivots - v.mean(axis=0)) ** 2).sum(axis=1).argmin())
                    far = np.sqrt(((v - pivots[pivot]) ** 2).sum(axis=1))
                    out.write(ids.astype(np.int64).tobytes() + y.astype(np.int32).tobytes() + v.tobytes())
                    told.append((name, offset, len(part), pivot, far.min(), far.max(), v.min(axis=0).tolist(), v.max(axis=0).tolist()))
                    offset += len(part) * (12 + 8 * width)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*told)], names=["file", "offset", "n", "pivot", "near", "far", "low", "high"])
        if out is not None:
            out.close()

    # a row for each shell
    told = dealt(known).mapInArrow(store, "file string, offset long, n long, pivot long, near double, far double, low array<double>, high array<double>").collect()
    column = lambda c: np.array([r[c] for r in told], np.float64)
    directory = Directory([(r["file"], r["offset"], r["n"]) for r in told], column("pivot").astype(int), column("near"), column("far"), column("low").reshape(len(told), width), column("high").reshape(len(told), width))

    def search(batches):
        shells = Reader(directory, width)
        for batch in batches:
            if batch.num_rows and directory.places:
                x, ids = rows_of(batch), batch.column("id").to_numpy()
                begin = runs_of(x)
                found = look_up(x[begin], k, size, pivots, shells)
                d, near, y = (np.concatenate([getattr(best, c) for best in found]) for c in ("d", "ids", "y"))
                of = np.repeat(np.arange(len(begin)), np.diff([*begin, len(x)]))
                r, at = np.nonzero(d[of] < np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[r], (at + 1).astype(np.int32), near[of[r], at], d[of[r], at], y[of[r], at])], names=["query", "rank", "neighbour", "distance", "y"])

    return dealt(asked).mapInArrow(search, "query long, rank int, neighbour long, distance double, y int")


def vote(found: DataFrame) -> DataFrame:
    """query, pred: the label of most neighbours; of equally many the nearest one's."""
    sign = F.sum(F.when(F.col("y") == 1, 1).otherwise(-1))
    votes = found.groupBy("query").agg(sign.alias("votes"), F.min_by("y", "rank").alias("nearest"))
    return votes.select("query", F.when(F.col("votes") > 0, 1).when(F.col("votes") < 0, -1).when(F.col("nearest") == 1, 1).otherwise(-1).alias("pred"))


@dataclass(frozen=True)
class Model:
    """The training rows themselves."""

    train: DataFrame
    k: int
    key: str = "id"
    vector: str = "features"
    block: int = Params.block

    def transform(self, queries: DataFrame) -> DataFrame:
        found = vote(neighbours(self.train, queries, self.k, key=self.key, vector=self.vector, block=self.block))
        return queries.join(found.withColumnRenamed("query", self.key), self.key, "left").withColumn("pred", F.coalesce("pred", F.lit(-1)))


def fit_model(train: DataFrame, params: Params = Params(), *, key: str = "id", vector: str = "features") -> Model:
    return Model(train, params.k, key, vector, params.block)
