import zlib

import pytest
from pyspark.sql import functions as F

from orrery.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot string, size int, t double"


def docs(spark, n=3000):
    rows = [(i, f"text {i % 50}" if i % 7 else None, "x", "y", 1, 0.5) for i in range(n)]
    return spark.createDataFrame(rows + [(None, "", "x", "y", 1, 0.5), (5, "again é" * 20_000, "x", "y", 1, 0.5), (5, "text 5", "x", "y", 1, 0.5), (None, None, "", "", 0, 0.0)], SCHEMA)


def test_sizes_checksums_and_slots(spark):
    rows = sharding.assign(docs(spark), [1.0] * 8).collect()
    assert len(rows) == 3004
    texts = {(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in docs(spark).collect()}
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in rows} == texts
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    for s in range(8):
        of = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in rows if r["shard"] == s)
        assert [x[0] for x in of] == list(range(len(of))) and [x[1:] for x in of] == sorted(x[1:] for x in of)
        assert 300 < len(of) < 460


def test_a_new_shard_takes_rows_into_itself_alone(spark):
    moved = sharding.moves(docs(spark), [1.0] * 8, [1.0] * 9).collect()
    assert {r["new_shard"] for r in moved} == {8} and 250 < len(moved) < 420
    gone = sharding.moves(docs(spark), [1.0] * 8, [1.0] * 7 + [0.0]).collect()
    assert {r["old_shard"] for r in gone} == {7}


def test_shares_follow_weights_and_a_heavier_shard_only_gains(spark):
    n = {r["shard"]: r["count"] for r in docs(spark).select(sharding.shard_of(F.col("doc_id"), [1.0, 2.0, 0.0, 3.0]).alias("shard")).groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3} and abs(n[0] - 500) < 90 and abs(n[1] - 1000) < 110 and abs(n[3] - 1500) < 120
    assert {r["new_shard"] for r in sharding.moves(docs(spark), [1.0, 2.0, 3.0], [1.0, 2.5, 3.0]).collect()} == {1}


@pytest.mark.parametrize("weights", [[], [0.0], [1.0, -1.0], [float("nan"), 1.0], [float("inf")]])
def test_weights_without_meaning_raise(weights):
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("x"), weights)


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = docs(spark).drop("shard")
    sharding.write(rows, [1.0, 1.0], f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 3004 and back.drop("shard").exceptAll(rows).count() == 0
    assert back.where(F.col("shard") != sharding.shard_of(F.col("doc_id"), [1.0, 1.0])).count() == 0
    with pytest.raises(ValueError):
        sharding.write(docs(spark), [1.0], f"{tmp_path}/no")


def test_empty_table(spark):
    assert sharding.assign(docs(spark).where("false"), [1.0, 1.0]).count() == 0


def test_one_key_in_a_third_of_all_rows_is_spread_over_ranges(spark, monkeypatch):
    seen, written = {}, sharding.common.written
    monkeypatch.setattr(sharding.common, "written", lambda df, name, **o: seen.setdefault(name, written(df, name, **o)))
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.assign(rows, [1.0, 1.0])
    assert found.count() == 9000 and found.groupBy("shard").agg((F.max("slot") - F.min("slot") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0
    assert seen["placed"].groupBy("__range").count().agg(F.max("count")).first()[0] < 9000 // 3
