"""Exact order statistics of packed float columns by counting, without a shuffle of the values.

A float32 has a 32-bit key in the order of its values. The first pass counts the keys' upper halves, or, for a feature of few
values in a task, the keys themselves; the second one counts whole keys below the upper halves that the wanted positions fall
in. What is shuffled is bounded by 65,536 counts a feature and task, however many rows there are, and by ``few`` + 1 a task for
a feature that has few values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import blocks


def keys_of(x: np.ndarray) -> np.ndarray:
    """uint32 keys that sort as float32 values do; -0.0 is 0.0."""
    u = (x.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(u >> 31, ~u, u | np.uint32(1 << 31))


def values_of(keys: np.ndarray) -> np.ndarray:
    k = np.asarray(keys, np.uint32)
    return np.where(k >> 31, k & np.uint32((1 << 31) - 1), ~k).astype(np.uint32).view(np.float32).astype(np.float64)


def _counted(kind: int, feature: int, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size = len(codes)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind)), pa.array(np.full(size, feature)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "feature", "code", "n"])


_SCHEMA = "kind long, feature long, code long, n long"


def first_counts(packed: DataFrame, features: int, few: int) -> list[tuple[dict[int, int], dict[int, int]]]:
    """For each feature (whole keys, upper halves) with their counts; the whole keys come from tasks that saw at most ``few``."""

    def count(batches):
        halves = [None] * features
        whole: list[dict | None] = [{} for _ in range(features)]
        for x, _ in blocks.unpacked(batches):
            for j in range(features):
                k = keys_of(x[:, j])
                if whole[j] is not None:
                    found, n = np.unique(k, return_counts=True)
                    if len(found) <= few and len(whole[j].keys() | set(found.tolist())) <= few:
                        for a, b in zip(found.tolist(), n.tolist()):
                            whole[j][a] = whole[j].get(a, 0) + b
                        continue
                    halves[j] = np.zeros(1 << 16, np.int64)
                    for a, b in whole[j].items():
                        halves[j][a >> 16] += b
                    whole[j] = None
                halves[j] += np.bincount(k >> 16, minlength=1 << 16)
        for j in range(features):
            if whole[j] is None:
                at = np.flatnonzero(halves[j])
                yield _counted(0, j, at, halves[j][at])
            elif whole[j]:
                yield _counted(1, j, np.array(list(whole[j])), np.array(list(whole[j].values())))

    out: list = [({}, {}) for _ in range(features)]
    for r in packed.mapInArrow(count, _SCHEMA).groupBy("kind", "feature", "code").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        out[r["feature"]][0 if r["kind"] == 1 else 1][r["code"]] = r["n"]
    return out


def at_positions(packed: DataFrame, halves: dict[int, dict[int, int]], positions: dict[int, list[int]]) -> dict[int, list[float]]:
    """The values at positions (from 0, ascending) of the sorted columns whose upper halves are counted."""
    asked, wanted = [], {}
    for j, places in positions.items():
        codes = np.array(sorted(halves[j]))
        upto = np.cumsum([halves[j][c] for c in codes.tolist()])
        at = np.searchsorted(upto, places, side="right")
        before = np.concatenate([[0], upto])[at]
        wanted[j] = np.unique(codes[at])
        asked += [(j, int(codes[a]), i, int(p - b)) for i, (p, a, b) in enumerate(zip(places, at, before))]

    def count(batches):
        for x, _ in blocks.unpacked(batches):
            for j, halves_of in wanted.items():
                k = keys_of(x[:, j])
                high = k >> 16
                found, n = np.unique(k[halves_of[np.searchsorted(halves_of, high).clip(max=len(halves_of) - 1)] == high], return_counts=True)
                if len(found):
                    yield _counted(0, j, found, n)

    if not asked:
        return {}
    counted = packed.mapInArrow(count, _SCHEMA).groupBy("feature", "code").agg(F.sum("n").alias("n")).withColumn("half", F.shiftright("code", 16))
    upto = F.sum("n").over(Window.partitionBy("feature", "half").orderBy("code"))  # at most 65,536 rows
    places = packed.sparkSession.createDataFrame(asked, "feature long, half long, i long, place long")
    found = counted.withColumn("upto", upto).join(F.broadcast(places), ["feature", "half"]).where("place >= upto - n and place < upto").select("feature", "i", "code").collect()
    out = {j: [0.0] * len(places) for j, places in positions.items()}
    for r in found:
        out[r["feature"]][r["i"]] = float(values_of(np.array([r["code"]]))[0])
    return out


def columns(packed: DataFrame, features: int, few: int, positions) -> list[tuple[list[float], list[float]]]:
    """For each feature (its sorted values, []) if it has at most ``few``, else ([], its values at positions(rows))."""
    first = first_counts(packed, features, few)
    halves, wanted = {}, {}
    for j, (whole, some) in enumerate(first):
        if some or len(whole) > few:
            halves[j] = dict(some)
            for code, n in whole.items():
                halves[j][code >> 16] = halves[j].get(code >> 16, 0) + n
            wanted[j] = positions(sum(halves[j].values()))
    found = at_positions(packed, halves, wanted)
    return [([], found.get(j, [])) if j in wanted else (values_of(np.array(sorted(first[j][0]), np.uint32)).tolist(), []) for j in range(features)]
