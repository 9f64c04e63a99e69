"""Shards by weighted rendezvous hashing of stable record keys.

Each pair of a key and a shard has a number u in (0, 1), made of a digest of both; a record belongs to the shard with the
smallest -ln(u) / weight. A shard's number doesn't depend on the other shards, so a new shard takes records into itself only,
a shard that goes gives its records to the others, and a change of one weight moves records from or to that shard alone. Shares
are in proportion to the weights. Places within a shard are counted by ranges, so no task holds a shard.

Cases: the key alone decides, so rows that repeat a key, or have none, share a shard (a hot key makes its shard larger, not a
task); a shard of weight 0 takes nothing, negative weights or none above 0 raise; a null text has size 1 and the checksum of no
bytes; rows with equal keys lie in the order of checksum and size; equal texts under different keys are separate records; an
empty table gives no rows; long texts are only measured; other columns are ignored by ``assign`` and kept by ``write``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common

#: Rows of a file that ``write`` makes.
FILE_ROWS = 1 << 16


def unit(key: Column, shard: int) -> Column:
    """The number of key and shard in (0, 1): 52 bits of an MD5 digest."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(f":{shard}"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key among shards 0, 1, ... of these weights."""
    if not any(w > 0 for w in weights) or not all(math.isfinite(w) and w >= 0 for w in weights):
        raise ValueError("weights have to be finite and not negative, and one above 0")
    cost = [F.struct((-F.ln(unit(key, s)) / F.lit(float(w))).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights) if w > 0]
    return (F.least(*cost) if len(cost) > 1 else cost[0]).getField("s")


def assign(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, shard, slot (from 0 in its shard, in the order of doc_id, null first)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("t"))
    small = rows.select(
        "doc_id", (F.coalesce(F.octet_length("t"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce("t", F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
    )
    return common.placed(common.written(small, "sharded"), "shard", ["doc_id", "text_crc32", "size"], "slot").drop("slot_of")


def moves(docs: DataFrame, before: list[float], after: list[float], key: str = "doc_id") -> DataFrame:
    """key, old_shard, new_shard of the rows that change their shard with the weights."""
    both = docs.select(key, shard_of(F.col(key), before).alias("old_shard"), shard_of(F.col(key), after).alias("new_shard"))
    return both.where("old_shard <> new_shard")


def write(docs: DataFrame, weights: list[float], path: str, key: str = "doc_id") -> None:
    """docs as Parquet in a folder for each shard; a shard is dealt over as many tasks as its rows need, in no order."""
    if "shard" in docs.columns:
        raise ValueError("docs already have a column named shard")
    rows = docs.withColumn("shard", shard_of(F.col(key), weights))
    parts = max(1, -(-rows.count() // FILE_ROWS))
    rows.repartition(parts, "shard", F.floor(F.rand(7) * parts)).write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").parquet(path)


#: Shards of the registered query.
SHARDS = 8


def op13_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(common.table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    grown = shard_of(F.col("doc_id"), [1.0] * (SHARDS + 1)).cast("int")
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", grown.alias("grown_shard"))


_COSTS = lambda n: "list_transform(range({n}), lambda s: -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0))".format(n=n)
ORACLE = f"""
WITH c AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) + 1 AS size, {common.crc32_sql("text")} AS text_crc32, {_COSTS(SHARDS)} AS few, {_COSTS(SHARDS + 1)} AS more FROM documents),
s AS (SELECT *, CAST(list_position(few, list_min(few)) - 1 AS INTEGER) AS shard, CAST(list_position(more, list_min(more)) - 1 AS INTEGER) AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""
