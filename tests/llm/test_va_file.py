"""Vector-approximation files: what is read, and odd vectors."""

import io

import numpy as np
import pytest

from orrery.llm import vafile


class Counted(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def chunk(v):
    low = v.min(axis=0)
    width = np.maximum(-(-(v.max(axis=0) - low + 1) // vafile.CELLS), 1)
    return low, width, ((v - low) // width).astype(np.uint8), vafile.Exact(Counted(v.astype("<i8").tobytes()), *v.shape)


def test_only_what_the_bounds_leave_is_read_and_results_are_exact():
    draw = np.random.default_rng(1)
    v = np.floor(256 * draw.normal(size=(5000, 16))).astype(np.int64)
    ids, q = np.arange(5000), v[::1000]
    low, width, cells, exact = chunk(v)
    rows, found, scores = vafile.search_chunk(q, ids[::1000], ids, low, width, cells, exact, 5)
    for r in range(len(q)):
        s = v @ q[r]
        best = [i for i in np.lexsort((ids, -s)) if i != ids[::1000][r]][:5]
        assert sorted(found[rows == r].tolist()) == sorted(best) and sorted(scores[rows == r]) == sorted(s[best])
    assert exact.read < 0.2 * len(v)


def test_large_components_rank_exactly_or_raise():
    v = np.array([[2**40, 1], [2**40, 3], [-(2**40), 5], [2**40, 2]], np.int64)
    ids = np.arange(4)
    q = np.array([[1, 1]], np.int64)
    rows, found, scores = vafile.search_chunk(q, np.array([9]), ids, *chunk(v), 3)
    assert [i for _, i in sorted(zip(-scores, found))] == [1, 3, 0]
    with pytest.raises(ValueError):
        vafile.search_chunk(q << 40, np.array([9]), ids, *chunk(v), 3)


def test_queries_meet_vectors_of_their_own_length(spark):
    rows = [(0, [1.0, 2.0], 1), (50, [1.0], 2), (1, [3.0], 3), (2, [2.0, 2.0], 4), (3, [float("inf"), 1.0], 5), (4, [], 6), (100, [1.0, 1.0, 1.0], 7)]
    v = vafile.integer_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<float>, rank int"))
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vafile.top_k(v, v.where("vec_id % 50 = 0")).collect())
    assert found == [(0, 1, 2), (50, 1, 1)]
    assert vafile.top_k(v.where("false"), v.where("false")).count() == 0
    with pytest.raises(Exception, match="too large"):
        vafile.integer_vectors(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()
