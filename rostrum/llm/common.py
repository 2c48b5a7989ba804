"""Shared plumbing of the training-data operators: input, partition counts, shared storage, Arrow views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.sources.store import fresh_path, shared_dir
from rostrum.sources.store import stored as settled

#: Code points that separate words everywhere in this subpackage (fixed values).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text whose share of a shuffle one task holds.
PART_BYTES = 32 << 20
#: A key is hot that holds more than one in so many rows; there are fewer hot keys than that.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """key: those of more than 1/HOT of all rows, so fewer than HOT of them. counts has a row for each key."""
    return settled(counts.where(F.col(n) * HOT > total).select(key), "hot-keys")


def join_hot(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined to a table with one row a key. Rows of hot keys stay where they are and meet the table's few rows of
    these by broadcast; all others are shuffled."""
    few = F.broadcast(hot)
    return rows.join(few, key, "left_anti").join(table, key).unionByName(rows.join(F.broadcast(table.join(few, key, "left_semi")), key))


def row_key(*cols: str):
    """A key of the row's content, so that rows which share a doc_id but not a text stay apart."""
    return F.xxhash64(*cols)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    body = body[offsets[0] : offsets[-1]]
    return offsets - offsets[0], body


def chunks(offsets: np.ndarray, size: int = 1 << 18):
    """Ranges [a, b) of documents that hold about `size` bytes; a longer document stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def given_back() -> None:
    """Returns the memory that Arrow keeps for later to the system, at the end of a task; workers live on between stages."""
    pa.default_memory_pool().release_unused()


def by_bytes(df: DataFrame, *columns: str) -> int:
    """Shuffle partitions for work that holds a partition in memory: at least the session's, more if a partition would
    hold over PART_BYTES of the columns' bytes."""
    size = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0).cast("long")))).first()[0] or 0
    return max(n_parts(df.sparkSession), -(-size // PART_BYTES))


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def binary_column(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


def quoted(names: list[str]) -> list[str]:
    """Column names as they are, whatever characters they hold."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that columns with clashing names can't reach it."""
    return df.select(*names)


__all__ = ["WORD", "binary_column", "by_bytes", "chunks", "clean_columns", "given_back", "fresh_path", "n_parts", "packed", "quoted", "row_key", "settled", "shared_dir", "table", "text_buffers", "F"]
