"""Shared storage, parameters and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Paths that this session has made in the shared folder; they go when the driver ends.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir; a local session may leave it unset and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made, os.getpid())
    _made.append(path)
    return path


def _remove_made(pid: int) -> None:
    if os.getpid() != pid:
        return
    for path in _made:
        try:
            fs, place = open_fs(path)
            fs.delete_dir(place)
        except Exception:  # noqa: BLE001  (what is gone, or can't be reached any more, stays as it is)
            pass


def made_since(count: int) -> list[str]:
    """The paths that this session has made after its first ``count``."""
    return _made[count:]


def made_count() -> int:
    return len(_made)


def remove(paths: list[str], reader: DataFrame) -> None:
    """Removes paths that this session has made, but those that ``reader`` still reads."""
    from pyarrow.fs import FileType

    read = [f.rpartition("://")[-1].removeprefix("file:").lstrip("/") for f in reader.inputFiles()]
    for path in paths:
        fs, place = open_fs(path)
        if not any(f.startswith(place.lstrip("/") + "/") for f in read) and fs.get_file_info(place).type == FileType.Directory:
            fs.delete_dir(place)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or a plain local path; usable on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of fewer rows than Spark's default of 10,000: as many texts take tens of MB in both processes at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10_000:
        spark.conf.set(key, str(rows))


def tidy(run):
    """run (a function of Arrow batches) that gives unused memory back at its end, since workers live on from stage to stage."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than one in SHARES of the rows, and with more than LEAST_HOT, is dealt over several tasks by skew_join.
SHARES, LEAST_HOT = 1000, 256


def skew_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right (columns named in ``on``) where one key may hold a large share of left's rows.

    Rows of a hot key get one of ceil(rows / limit) salts, and right's rows of that key are repeated for each. Fewer than
    SHARES keys can be hot and they have fewer than 2 * SHARES salts in all, so what is broadcast and repeated is bounded
    at any size. ``left`` is read twice: give a written table, or ``counts`` (on, n) of it.
    """
    on = [on] if isinstance(on, str) else on
    if counts is None:
        counts = left.where(functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))).groupBy(*on).agg(F.count("*").alias("n"))
    counts = written(counts.select(*on, "n").where(F.col("n") > LEAST_HOT), "hot")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(LEAST_HOT, -(-total // SHARES))
    hot = counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("__salts")).collect()
    if not hot:
        return left.join(right, on, how)
    keys = F.broadcast(left.sparkSession.createDataFrame(hot, counts.select(*on, F.lit(0).alias("__salts")).schema))
    salt = F.coalesce(F.floor(F.rand(11) * F.col("__salts")).cast("int"), F.lit(0))
    dealt = left.join(keys, on, "left").withColumn("__salt", salt).drop("__salts")
    copies = right.join(keys, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")


def crc32_of(column) -> "F.Column":
    return F.crc32(column.cast("string").cast("binary"))


def row_parallelism(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def placed(rows: DataFrame, per: str, order: list[str], name: str) -> DataFrame:
    """rows with ``name``, the place (from 0) among those of the same ``per`` in ascending ``order``, nulls first, and
    ``name``_of, their number. ``rows`` are read twice: give a written table.

    Rows are dealt to ranges of the order, ties too, and row_number counts within a range; ranges are offset by the counts
    of those before them, so no task holds all rows of a ``per``, and a key that repeats is spread.
    """
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(row_parallelism(rows.sparkSession), per, *order, "__tie")
    dealt = written(dealt.withColumn("__range", F.spark_partition_id()), "placed")
    counts = dealt.groupBy(per, "__range").agg(F.count("*").alias("__n"))
    every = Window.partitionBy(per)  # a row for each range
    upto = every.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(per).alias("__per"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias(f"{name}_of"))
    local = F.row_number().over(Window.partitionBy(per, "__range").orderBy(*order, "__tie"))
    found = dealt.withColumn(name, local).join(offsets, F.col(per).eqNullSafe(F.col("__per")) & (F.col("__range") == F.col("__r")))
    return found.withColumn(name, F.col(name) + F.col("__before") - 1).drop("__tie", "__range", "__r", "__per", "__before")


def crc32_sql(column: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string's UTF-8 bytes (null: of none), by the table of the reversed polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    step = f"xor(c >> 8, list_extract({table}::BIGINT[], CAST(xor(c & 255, b) + 1 AS BIGINT)))"
    of = f"list_transform(regexp_extract_all(hex(encode(coalesce({column}, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {of}), lambda c, b: {step}), 4294967295)"
