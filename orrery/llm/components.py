"""Connected components of an edge table by alternating large stars and small stars.

Edges (v, r) lead from a vertex to a smaller one. A large star hangs every larger neighbour of a vertex on the smallest vertex
of its neighbourhood; a small star does so with the smaller neighbours. Both keep the components, and they end, after a
number of rounds that is logarithmic in the number of vertices, in stars around the smallest vertices. Between them, tasks
replace the edges that they hold by a spanning forest of as many edges or fewer. No table of vertices is brought to the
driver, and a vertex with very many neighbours is dealt over several tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import common

#: Edges that a task holds at once.
WINDOW = 200_000


def forest(edges: DataFrame) -> DataFrame:
    """Edges (v, r) of stars around the smallest vertices, of the same components, for each window of each task's edges."""

    def roots(batches):
        up: dict[int, int] = {}

        def root(x):
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while (above := up.get(x, x)) != top:
                up[x] = top
                x = above
            return top

        def stars():
            found = [(v, root(v)) for v in up]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["v", "r"])

        seen = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    up.setdefault(min(a, b), min(a, b))
            seen += batch.num_rows
            if seen >= WINDOW:
                yield stars()
                seen = 0
        if up:
            yield stars()

    return edges.mapInArrow(roots, "v long, r long").where("v <> r")


def _large_stars(edges: DataFrame) -> DataFrame:
    both = common.written(edges.select("v", F.col("r").alias("w")).union(edges.select("r", "v")), "both")
    least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
    return common.skew_join(both.where("w > v"), least, "v").select(F.col("w").alias("v"), F.col("m").alias("r")).where("v <> r").distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("r").alias("m"))
    hung = common.skew_join(edges, least, "v").where("r <> m").select(F.col("r").alias("v"), F.col("m").alias("r"))
    return hung.union(least.toDF("v", "r")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every end of edges (a, b); component: the smallest vertex that can be reached.

    Null ends and loops are no edges; edges may repeat and stand in either order; without edges there are no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r")).where("a is not null and b is not null and a <> b")
    now = common.written(forest(now), "forest")
    while True:
        # stars: every vertex hangs on one other, which itself hangs on none
        twice = now.groupBy("v").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b")
        if twice.isEmpty() and now.select("r").distinct().join(now.select(F.col("v").alias("r")), "r", "left_semi").isEmpty():
            break
        now = common.written(_large_stars(now), "large")
        now = common.written(forest(_small_stars(now)), "small")
    now = now.distinct()
    return now.union(now.select("r", "r").distinct()).toDF("v", "component")
