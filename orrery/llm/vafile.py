"""Exact top-k by inner product with vector-approximation files.

Candidates are held in chunks: a table has each chunk's ids and quantised cells (one byte a component), a file of its own the
exact integer vectors, row by row. A search scans the cells of a chunk for upper bounds of the scores, then reads exact
vectors from the file, by their offsets, in the order of these bounds until the k-th result is certain: the next bound is
below the k-th score found. Exact vectors that no bound asks for are never read. Queries are read block by block from the
shared folder, so neither side has to fit into memory; chunks' results are merged by score and id.

Cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths have no
score, so a query is compared with those of its own length (more than LENGTHS lengths raise); rows without id take no part;
rows that repeat an id are candidates each, but no row is a candidate for a query of its own id; ties go to the smaller id;
fewer than k candidates give fewer rows; scores that might not fit 62 bits raise; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import common

CHUNK, QUERY_BLOCK, CELLS, LENGTHS = 16_384, 512, 64, 64


def integer_vectors(table: DataFrame, scale: int = 256, also: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """vec_id, ``also`` and v: floor(scale * x) of each component; only usable vectors."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = table.select(F.col("vec_id").cast("long").alias("vec_id"), *also, x.alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    whole = lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large")))
    return good.select("vec_id", *also, F.transform("embedding", whole).alias("v"))


class Exact:
    """The exact vectors of a chunk, read by their offsets when they are first asked for; runs of rows are read at once."""

    def __init__(self, file, rows: int, width: int):
        self.file, self.width = file, width
        self.rows, self.known, self.read = np.zeros((rows, width), np.int64), np.zeros(rows, bool), 0

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        new = np.unique(at[~self.known[at]])
        for run in np.split(new, np.flatnonzero(np.diff(new) > 1) + 1) if len(new) else ():
            raw = self.file.read_at(8 * self.width * len(run), 8 * self.width * int(run[0]))
            self.rows[run] = np.frombuffer(raw, "<i8").reshape(len(run), self.width)
            self.read += len(run)
        self.known[new] = True
        return self.rows[at]


def build(vectors: DataFrame, name: str = "va-file") -> DataFrame:
    """The file: one row per chunk with ids, low and width (cells of each dimension), cells and the path of its exact vectors; written."""
    base = common.shared_path(vectors.sparkSession, f"{name}-exact")

    @common.tidy
    def chunks(batches):
        fs, place = common.open_fs(base)
        kept: list = []

        def out():
            ids = np.array([r[0] for r in kept], np.int64)
            v = np.array([r[1] for r in kept], np.int64)
            low = v.min(axis=0)
            width = np.maximum(-(-(v.max(axis=0) - low + 1) // CELLS), 1)
            cells = ((v - low) // width).astype(np.uint8)
            path = f"{place}/{uuid.uuid4().hex}.exact"
            fs.create_dir(place, recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(v.astype("<i8").tobytes())
            cols = [ids.tobytes(), low.tobytes(), width.tobytes(), cells.tobytes()]
            return pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in cols), pa.array([path])], names=["ids", "low", "width", "cells", "exact"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept.append(row)
                if len(kept) == CHUNK:
                    yield out()
                    kept = []
        if kept:
            yield out()

    return common.written(vectors.mapInArrow(chunks, "ids binary, low binary, width binary, cells binary, exact string"), name)


def search_chunk(q: np.ndarray, qid: np.ndarray, ids, low, width, cells, exact, k: int):
    """(query row, id, score) of the k best candidates of one chunk for each query (int64); ties to the smaller id."""
    centre = low + cells * width + (width - 1) / 2
    far, near = np.abs(q).sum(axis=1, dtype=np.float64), np.abs(centre).max() + width.max() / 2
    if (far * near).max(initial=0) >= 2.0**62:
        raise ValueError("scores don't fit 62 bits")
    x = q.astype(np.float64)
    # what doubles may have lost of the products goes on top of the bounds
    upper = x @ centre.T + (np.abs(x) @ ((width - 1) / 2) + far * near * len(width) * 2.0**-50)[:, None]
    upper[qid[:, None] == ids[None, :]] = -np.inf
    rows, found, scores = [], [], []
    first = min(4 * k, len(ids))
    for r in range(len(q)):
        u, take = upper[r], first
        while True:
            at = np.argpartition(-u, take - 1)[:take] if take < len(ids) else np.arange(len(ids))
            bound = np.delete(u, at).max() if take < len(ids) else -np.inf
            at = at[u[at] > -np.inf]
            s = exact[at] @ q[r]
            best = np.lexsort((ids[at], -s))[:k]
            if bound == -np.inf or (len(best) == k and s[best[-1]] > bound):
                break
            take = min(4 * take, len(ids))
        rows += [r] * len(best)
        found.append(ids[at[best]])
        scores.append(s[best])
    return np.array(rows, np.int64), np.concatenate(found), np.concatenate(scores)


def candidates(vectors: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best vectors of each chunk for each query, of vectors of one length."""
    spark = vectors.sparkSession
    file = build(vectors.where(F.size("v") == width))
    path = common.shared_path(spark, "queries")
    queries.where(F.size("v") == width).write.parquet(path)

    @common.tidy
    def search(batches):
        import pyarrow.dataset as ds

        fs, base = common.open_fs(path)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                low, wide = (np.frombuffer(row[c], np.int64) for c in ("low", "width"))
                cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), -1)
                with fs.open_input_file(row["exact"]) as f:
                    exact = Exact(f, len(ids), width)
                    for block in ds.dataset(base, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_BLOCK):
                        if block.num_rows:
                            qid = block.column("vec_id").to_numpy()
                            q = np.asarray(block.column("v").flatten()).reshape(len(qid), -1)
                            r, found, s = search_chunk(q, qid, ids, low, wide, cells, exact, k)
                            yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(found), pa.array(s)], names=["query_id", "vec_id", "score"])

    return file.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors (vec_id, v) for each query (vec_id, v)."""
    widths = sorted(r["n"] for r in queries.select(F.size("v").alias("n")).distinct().limit(LENGTHS + 1).collect())
    if len(widths) > LENGTHS:
        raise ValueError(f"queries of more than {LENGTHS} lengths")
    found = [candidates(vectors, queries, w, k) for w in widths or [0]]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return functools.reduce(DataFrame.union, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
