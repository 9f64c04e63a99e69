"""Hard negatives for contrastive training, by branch and bound over ball trees.

Vectors are dealt to partitions of about ROWS rows; each one gets a tree of balls (centre, radius) over halves of its rows, kept
in the shared folder. For a query q and a ball, q.c - |q| r and q.c + |q| r bound all inner products from below and above. A
search visits the trees with a block of queries at once; at each node only those queries go on whose window of scores meets
the bounds, and whose k-th score so far isn't strictly above the upper one. So ties are kept, and results are exact. Searches
for the positives of the anchors (same label, no window) and for their negatives (another label, scores between a share of the
positive's score and that score) are the same search with other windows. Both sides are read block by block, HELD trees and
QUERIES queries at a time; the best of a task's held trees are merged there, those of all tasks by a window over each query.

Cases: rows with a null id, a null label, a vector that is null, empty or holds null or non-finite components take no part;
vectors of different lengths have no score, and more than LENGTHS lengths raise; anchors that repeat an id are anchors each,
rows that do so are candidates each, but no row is found for an anchor of its own id; fewer than k rows give fewer results,
an anchor without positives gives none; scores that might not fit 55 bits raise; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import common, vafile

ROWS, LEAF, HELD, QUERIES, LENGTHS = 8192, 64, 4, 1024, 64
_NONE, _MOST = -(2**62), 2**55


@dataclass
class BallTree:
    """Rows in the order of the leaves; nodes in preorder: start, end of their rows, right child (-1: leaf), centre, radius."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    span: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    FIELDS = (("ids", "<i8"), ("labels", "<i8"), ("v", "<i8"), ("span", "<i8"), ("right", "<i8"), ("centre", "<f8"), ("radius", "<f8"))

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> BallTree:
        order, x = np.arange(len(ids)), v.astype(np.float64)
        span, right, centre, radius = [], [], [], []

        def grow(start: int, end: int) -> None:
            at, rows = len(span), order[start:end]
            c = x[rows].mean(axis=0)
            far = ((x[rows] - c) ** 2).sum(axis=1)
            span.append((start, end))
            right.append(-1)
            centre.append(c)
            radius.append(np.sqrt(far.max()) * (1 + 1e-9))
            if end - start <= leaf:
                return
            # halves along the line between two rows that lie far apart; equal rows are halved too
            a = x[rows[far.argmax()]]
            b = x[rows[((x[rows] - a) ** 2).sum(axis=1).argmax()]]
            half = (end - start) // 2
            order[start:end] = rows[np.argpartition(x[rows] @ (b - a), half)]
            grow(start, start + half)
            right[at] = len(span)
            grow(start + half, end)

        grow(0, len(ids))
        return cls(ids[order], labels[order], v[order], np.array(span), np.array(right), np.array(centre), np.array(radius))

    def row(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name)).astype(kind).tobytes() for name, kind in self.FIELDS]

    @classmethod
    def read(cls, row: dict, width: int) -> BallTree:
        raw = {name: np.frombuffer(row[name], kind) for name, kind in cls.FIELDS}
        return cls(**raw | {"v": raw["v"].reshape(-1, width), "span": raw["span"].reshape(-1, 2), "centre": raw["centre"].reshape(-1, width)})


@dataclass
class Queries:
    """A block of queries: id (no row of it is found), label, same (whether found rows have that label), window of scores (both
    ends included), vectors; and the best scores and ids so far, best first."""

    ids: np.ndarray
    labels: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    q: np.ndarray
    k: int

    def __post_init__(self):
        self.x = self.q.astype(np.float64)
        self.norm = np.sqrt((self.x**2).sum(axis=1)) * (1 + 1e-9)
        self.score = np.full((len(self.ids), self.k), _NONE)
        self.found = np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        self.compared = 0


def largest(q: np.ndarray, v: np.ndarray) -> float:
    """Above any sum of products of components."""
    return float(np.abs(q).sum(axis=1, dtype=np.float64).max(initial=0)) * float(np.abs(v).max(initial=0))


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where all sums fit their 53 bits."""
    far = largest(q, v)
    return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if far < 2.0**53 else q @ v.T


def search(tree: BallTree, block: Queries) -> None:
    """Puts the rows of a tree that are among a query's k best into its results."""

    def leaf(start: int, end: int, who: np.ndarray) -> None:
        ids, s = tree.ids[start:end], scores(block.q[who], tree.v[start:end])
        block.compared += s.size
        fits = (tree.labels[None, start:end] == block.labels[who, None]) == block.same
        fits &= (ids[None, :] != block.ids[who, None]) & (s >= block.low[who, None]) & (s <= block.high[who, None])
        s = np.where(fits, s, _NONE)
        better = (s >= block.score[who, -1:]).any(axis=1) & fits.any(axis=1)
        who, s = who[better], s[better]
        every = np.concatenate([block.score[who], s], axis=1)
        names = np.concatenate([block.found[who], np.broadcast_to(ids, s.shape)], axis=1)
        first = np.lexsort((names, -every), axis=1)[:, : block.k]
        block.score[who], block.found[who] = np.take_along_axis(every, first, 1), np.take_along_axis(names, first, 1)

    def bounds(node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = block.x[who] @ tree.centre[node]
        # what doubles may have lost goes on top
        slack = block.norm[who] * (tree.radius[node] + (np.sqrt((tree.centre[node] ** 2).sum()) + tree.radius[node]) * len(tree.centre[node]) * 2.0**-50)
        return middle - slack, middle + slack

    def visit(node: int, who: np.ndarray, below: np.ndarray, above: np.ndarray) -> None:
        alive = (above >= block.low[who]) & (below <= block.high[who]) & (above >= block.score[who, -1])
        who = who[alive]
        if not len(who):
            return
        if tree.right[node] < 0:
            leaf(*tree.span[node], who)
            return
        sides = [(child, *bounds(child, who)) for child in (node + 1, tree.right[node])]
        for child, b, a in sorted(sides, key=lambda s: -np.minimum(s[2], block.high[who]).mean()):
            visit(child, who, b, a)

    if largest(block.q, tree.v) >= _MOST:
        raise ValueError("scores don't fit 55 bits")
    who = np.arange(len(block.ids))
    visit(0, who, *bounds(0, who))


def build(vectors: DataFrame) -> DataFrame:
    """A row for each tree over vectors (vec_id, label, v; a written table): its arrays and width; written."""

    @common.tidy
    def grown(batches):
        kept: dict[int, list] = {}

        def out(width):
            ids, labels, v = zip(*kept.pop(width))
            row = BallTree.of(np.array(ids, np.int64), np.array(labels, np.int64), np.array(v, np.int64)).row()
            return pa.RecordBatch.from_arrays([pa.array([width]), *(pa.array([c], pa.binary()) for c in row)], names=["width", *(n for n, _ in BallTree.FIELDS)])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                some = kept.setdefault(len(row[2]), [])
                some.append(row)
                if len(some) == ROWS:
                    yield out(len(row[2]))
        for width in list(kept):
            yield out(width)

    parts = max(1, -(-vectors.count() // ROWS))
    return common.written(vectors.select("vec_id", "label", "v").repartition(parts).mapInArrow(grown, "width long, " + ", ".join(f"{n} binary" for n, _ in BallTree.FIELDS)), "ball-trees")


def best(trees: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """q, id, label, low, high of queries (and v) with rank, found, score: the k best rows inside [low, high] with the query's label
    (``same``) or another one; by score, ties to the smaller id. q is unique."""
    spark = trees.sparkSession
    path = common.shared_path(spark, "queries")
    queries.select("q", "id", "label", "low", "high", "v", F.size("v").alias("width")).write.partitionBy("width").parquet(path)
    told = ("q", "id", "label", "low", "high")

    @common.tidy
    def visited(batches):
        import pyarrow.dataset as ds
        from pyarrow import fs as pafs

        fs, base = common.open_fs(path)

        def against(held, width):
            place = f"{base}/width={width}"
            if fs.get_file_info(place).type == pafs.FileType.NotFound:
                return
            for part in ds.dataset(place, filesystem=fs, format="parquet").to_batches(batch_size=QUERIES):
                if not part.num_rows:
                    continue
                cols = {c: part.column(c).to_numpy() for c in told}
                block = Queries(cols["id"], cols["label"], same, cols["low"], cols["high"], np.asarray(part.column("v").flatten()).reshape(-1, width), k)
                for tree in held:
                    search(tree, block)
                r, at = np.nonzero(block.score > _NONE)
                yield pa.RecordBatch.from_arrays([*(pa.array(cols[c][r]) for c in told), pa.array(block.found[r, at]), pa.array(block.score[r, at])], names=[*told, "found", "score"])

        held: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                width = row["width"]
                held.setdefault(width, []).append(BallTree.read(row, width))
                if sum(map(len, held.values())) == HELD:
                    for w in list(held):
                        yield from against(held.pop(w), w)
        for w in list(held):
            yield from against(held.pop(w), w)

    found = trees.mapInArrow(visited, ", ".join(f"{c} long" for c in told) + ", found long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors (vec_id, label, v) that
    ``anchors`` picks: up to ``negatives`` rows of other labels whose score s satisfies a * p <= b * s <= b * p for (a, b) =
    ``least`` and the positive's score p."""
    a, b = least
    vectors = common.written(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    widths = vectors.where(anchors).select(F.size("v")).distinct().limit(LENGTHS + 1).count()
    if widths > LENGTHS:
        raise ValueError(f"anchors of more than {LENGTHS} lengths")
    trees = build(vectors)
    picked = vectors.where(anchors)
    free = picked.select(F.col("row").alias("q"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.lit(_NONE + 1).alias("low"), F.lit(-_NONE).alias("high"), "v")
    near = common.written(best(trees, free, positives, True).select("q", F.col("found").alias("positive_id"), F.col("score").alias("p")), "positives")
    # at most ``positives`` rows for each anchor
    pairs = near.join(picked.select(F.col("row").alias("q"), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), "v"), "q")
    pairs = common.written(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    # the smallest s with a * p <= b * s; scores are whole
    low = F.expr(f"p * {a}L div {b}L + if((p * {a}L) % {b}L > 0, 1, 0)")
    asked = pairs.select(F.col("pair").alias("q"), "id", "label", low.cast("long").alias("low"), F.col("p").alias("high"), "v")
    found = best(trees, asked, negatives, False).select(F.col("q").alias("pair"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    found = pairs.select("pair", F.col("id").alias("anchor_id"), "positive_id", F.col("p").alias("positive_score")).join(found, "pair")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.table(spark, sf_dir, "embeddings").where("label is not null and vec_id is not null")
    labels = table.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return mined(vafile.integer_vectors(labels, also=["label"]), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH u AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
