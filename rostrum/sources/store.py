"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, as in tests, a local folder serves a local master; a cluster has to name
    one, since its machines don't share local folders."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rostrum-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, bytes and time of change of each file under a path, in order; tells whether a table has changed since."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


_open = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes within the block are removed at its end, failed or not, except those that outlive it.
    Blocks nest; a table that outlives one belongs to the next outer one. For jobs that run to their end inside: a result
    that has yet to read such a table has to be stored with `outlives` first."""
    blocks = _open.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, what: str = "table", outlives: bool = False) -> DataFrame:
    """Written to the shared folder and read again: plans stay short, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    blocks = _open.__dict__.get("blocks", [])
    if len(blocks) > outlives:
        blocks[-1 - outlives].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
