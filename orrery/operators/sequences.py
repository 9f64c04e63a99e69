"""Rows dealt once to the workers of a sequential model, in a seeded order, and read by them block by block in every epoch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery import storage
from orrery.operators import blocks, ordering


@dataclass(frozen=True)
class Dealt:
    """The path of the dealt rows, and how many there are."""

    path: str
    rows: int

    def blocks(self, worker: int, seed: int, epoch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(x, y) of a worker's blocks: in the dealt order in epoch 0, later in a permutation of blocks and of the rows of each."""
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        fs, base = storage.open_fs(f"{self.path}/worker={worker}")
        if fs.get_file_info(base).type == pafs.FileType.NotFound:
            return
        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet"))
        groups = [(n, g) for n in names for g in range(pq.read_metadata(n, filesystem=fs).num_row_groups)]
        draw = np.random.default_rng([seed, epoch, worker])
        for at in range(len(groups)) if not epoch else draw.permutation(len(groups)):
            name, group = groups[at]
            with fs.open_input_file(name) as f:
                found = pq.ParquetFile(f).read_row_group(group)
            for n, x, y in zip(*(found.column(c).to_pylist() for c in ("n", "x", "y"))):
                x, y = np.frombuffer(x, np.float32).reshape(n, -1), np.frombuffer(y, np.int8)
                order = draw.permutation(n) if epoch else slice(None)
                yield x[order], y[order]

    def batches(self, worker: int, seed: int, epoch: int, size: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """The first ``most`` batches of ``size`` rows of a worker, in pieces of a block at most, and whether a piece ends its batch."""
        left, given = size, 0
        for x, y in self.blocks(worker, seed, epoch):
            at = 0
            while at < len(x):
                if given == most:
                    return
                take = min(left, len(x) - at)
                left -= take
                yield x[at : at + take], y[at : at + take], left == 0
                at += take
                if left == 0:
                    left, given = size, given + 1


def dealt(train: DataFrame, features: list[str], keys: list[str], workers: int, *, batch: int = 1, seed: int = 42, ties: list[str] | None = None) -> Dealt:
    """Complete rows (features, y) dealt to workers: in the order of the seeded shuffle, ``batch`` rows to each in turn; written.

    Rows are sorted by ranges and packed there, so no task holds all of them; the ranges' counts give every block the rank of its
    first row, and from then on blocks are dealt, not rows.
    """
    order, columns = list(dict.fromkeys(["_order", *(ties or keys)])), [f"x{i}" for i in range(len(features))]
    complete = blocks.complete(train, features).withColumn("_order", ordering.shuffled(train, keys, seed))
    rows = complete.select(*order, *(F.col(f).cast("float").alias(c) for f, c in zip(features, columns)), F.col("y").cast("int").alias("y"))
    turn, most = batch * workers, blocks.ROWS

    def told(columns: list[str], found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=columns)

    def pack(batches: Iterator[pa.RecordBatch]):
        own, start = TaskContext.get().partitionId(), 0
        for found in batches:
            for at in range(0, found.num_rows, most):
                part = found.slice(at, most)
                yield told(["range", "start", "n", "x", "y"], [(own, start, part.num_rows, blocks.matrix(part, columns).tobytes(), part.column("y").to_numpy().astype(np.int8).tobytes())])
                start += part.num_rows

    def deal(batches: Iterator[pa.RecordBatch]):
        for found in batches:
            for start, n, x, y in zip(*(found.column(c).to_pylist() for c in ("start", "n", "x", "y"))):
                x, y, place = np.frombuffer(x, np.float32).reshape(n, -1), np.frombuffer(y, np.int8), start + np.arange(n)
                worker, at = place % turn // batch, place // turn * batch + place % batch
                by = np.argsort(worker, kind="stable")
                parts = np.split(by, np.flatnonzero(np.diff(worker[by])) + 1)
                yield told(["worker", "at", "n", "x", "y"], [(int(worker[p[0]]), int(at[p[0]]), len(p), x[p].tobytes(), y[p].tobytes()) for p in parts])

    def join(batches: Iterator[pa.RecordBatch]):
        """Blocks of one worker that follow each other, as blocks of ``most`` rows."""
        now, held, n = -1, [], 0

        def cut(least: int):
            nonlocal held, n
            if n >= least:
                x, y = (b"".join(h[i] for h in held) for i in (1, 2))
                wide = len(x) // n
                for at in range(0, n - least + 1, most):
                    size = min(most, n - at)
                    yield told(["worker", "at", "n", "x", "y"], [(now, 0, size, x[at * wide : (at + size) * wide], y[at : at + size])])
                left = n % most if least > 1 else 0
                held, n = ([(left, x[(n - left) * wide :], y[n - left :])] if left else []), left

        for found in batches:
            for worker, *part in zip(*(found.column(c).to_pylist() for c in ("worker", "n", "x", "y"))):
                if worker != now:
                    yield from cut(1)
                now, n = worker, n + part[0]
                held.append(part)
                yield from cut(most)
        yield from cut(1)

    path = storage.shared_path(train.sparkSession, "dealt")
    ranges = storage.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns, "y").mapInArrow(pack, "range int, start long, n long, x binary, y binary"), "ranges")
    counts = ranges.groupBy("range").agg(F.sum("n").alias("rows"))
    # a row for each range: bounded by the number of partitions
    before = counts.select("range", F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranges.join(F.broadcast(before), "range").select((F.col("start") + F.col("before")).alias("start"), "n", "x", "y")
    schema = "worker int, at long, n long, x binary, y binary"
    by_worker = placed.mapInArrow(deal, schema).repartitionByRange("worker", "at").sortWithinPartitions("worker", "at").mapInArrow(join, schema)
    by_worker.drop("at").write.option("parquet.block.size", 4 << 20).partitionBy("worker").parquet(path)
    return Dealt(path, counts.agg(F.sum("rows")).first()[0] or 0)
