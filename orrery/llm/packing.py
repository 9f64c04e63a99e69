"""Best-two-fit packing of token documents into sequences of a fixed length.

The packing depends on lengths alone, so it is planned over the counts of lengths (at most ``size`` of them) of the whole
table: a bin is filled greedily with the longest pieces that fit, then its smallest piece gives way to two unpacked ones
where these fill the widened gap more tightly. A bin found so is repeated while its lengths last; each repetition ends
with a length used up, so the plan has few bins of different kind however large the table is. Pieces then take the places
of their length by their rank among equals, which salted counts give without one task seeing all of them.

Cases: a null text counts as empty, so the document is its end id alone; repeated rows are packed each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import common
from orrery.llm.tokens import default_tokenizer, encoder, forget

#: Pieces of one length that a task ranks: one in SHARES of all, but at least LEAST and at most MOST.
SHARES, LEAST, MOST = 1000, 256, 200_000


def token_pieces(docs: DataFrame, *, size: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document with its end id; only those above ``size`` ids are cut,
    from their end on, so that only the first piece can be shorter."""
    common.text_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    end = np.asarray([end_id], "<u4").tobytes()

    @common.tidy
    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    ends = list(range(n % size or size, n + 1, size)) if n > size else [n]
                    a = 0
                    for k, b in enumerate(ends):
                        rows.append((doc, k, a, b - a, zlib.crc32(raw[a * 4 : b * 4])))
                        a = b
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(times, lengths in order) of every kind of bin; ``counts[n]`` pieces have the length n, up to len(counts) - 1."""
    left, size = counts.astype(np.int64).copy(), len(counts) - 1
    bins: list[tuple[int, list[int]]] = []
    lengths = np.arange(size + 1)
    while left.any():
        fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # longest unpacked length up to each
        used: dict[int, int] = {}
        order: list[int] = []
        gap = size
        while gap:
            n = int(fits[gap])
            while n and left[n] - used.get(n, 0) <= 0:
                n = int(fits[n - 1])
            if not n:
                break
            times = min(int(left[n]) - used.get(n, 0), gap // n)
            used[n] = used.get(n, 0) + times
            order += [n] * times
            gap -= n * times
        if gap and len(order) > 1:
            small = order[-1]
            wide = gap + small
            free = left.copy()
            for n, k in used.items():
                free[n] -= k
            fits = np.maximum.accumulate(np.where(free > 0, lengths, 0))
            first = np.flatnonzero(free[: wide + 1] > 0)
            first = first[first > 0]
            second = fits[wide - first]
            alone = (second == first) & (free[first] < 2)
            below = np.where(first > 0, fits[np.maximum(first - 1, 0)], 0)
            second = np.where(alone, below, second)
            total = np.where(second > 0, first + second, 0)
            best = int(total.argmax()) if len(total) else -1
            if best >= 0 and total[best] > small:
                order[-1:] = sorted((int(first[best]), int(second[best])), reverse=True)
                used[small] -= 1
                for n in order[-2:]:
                    used[n] = used.get(n, 0) + 1
        times = min(int(left[n]) // k for n, k in used.items() if k)
        for n, k in used.items():
            left[n] -= k * times
        bins.append((times, order))
    return bins


def places(bins: list[tuple[int, list[int]]], size: int) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks and where they go: first rank, first sequence, offset, equal pieces in a bin."""
    rows, seen, sequence = [], np.zeros(size + 1, np.int64), 0
    for times, order in bins:
        offset = 0
        for n in sorted(set(order), reverse=True):
            k = order.count(n)
            rows.append((n, int(seen[n]), sequence, offset, k))
            seen[n] += times * k
            offset += n * k
        sequence += times
    table = np.asarray(rows or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"key": table[:, 0] << 44 | table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "k": table[:, 4]}


def pack(pieces: DataFrame, *, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    pieces = common.written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # a length with many pieces is dealt over as many salts as it needs
    counts = pieces.groupBy("length").count().collect()
    ranked_at_once = min(MOST, max(LEAST, sum(k for _, k in counts) // SHARES))
    salts = [(n, -(-k // ranked_at_once)) for n, k in counts]
    dealt = F.broadcast(pieces.sparkSession.createDataFrame(salts, "length long, _salts int"))
    salted = pieces.join(dealt, "length").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int"))
    table = np.zeros((size + 1, max([k for _, k in salts], default=1)), np.int64)
    for n, salt, k in salted.groupBy("length", "_salt").count().collect():
        table[n, salt] = k
    before = np.cumsum(table, axis=1) - table
    where = places(plan_bins(table.sum(axis=1)), size)
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "_row")) - 1)

    @common.tidy
    def place(batches):
        forget()
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n, salt, rank = (c[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "_salt", "_rank"))
            rank = rank + before[n, salt]
            at = np.searchsorted(where["key"], n << 44 | rank, side="right") - 1
            rank -= where["first"][at]
            k = where["k"][at]
            yield pa.RecordBatch.from_arrays(
                [*(c[x] for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(where["sequence"][at] + rank // k), pa.array(where["offset"][at] + rank % k * n)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, size: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    return pack(token_pieces(docs, size=size, end_id=end_id, tokenizer=tokenizer), size=size)


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
