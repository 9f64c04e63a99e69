"""Intermediate tables in the folder that all executors share; they go when the driver ends."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths that this session has made.
_made: list[str] = []


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or a plain local path; usable on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _remove_made(pid: int) -> None:
    if os.getpid() != pid:  # a worker that was forked
        return
    for path in _made:
        try:
            fs, place = open_fs(path)
            fs.delete_dir(place)
        except Exception:  # noqa: BLE001  (what is gone, or can't be reached any more, stays as it is)
            pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made, os.getpid())
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
