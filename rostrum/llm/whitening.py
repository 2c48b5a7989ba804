"""Embedding whitening: distributed block matrices of centred rows, a local eigendecomposition, a block product that projects.

Each entry c of a vector, as double, becomes the whole number x = floor(1024 c) + 100000. Rows are numbered and centred,
become an MLlib IndexedRowMatrix and from that a BlockMatrix Y. The product of Y's transpose with Y is the scatter matrix,
of which only the sum (dimensions squared) reaches the driver; its eigenvectors over the roots of their eigenvalues are the
whitening matrix, and the product of Y with that projects every row.

Sums are exact; so is the deviation. Rows of a block grow with the table (`block_rows`), and the inner dimension of the
scatter product is split, so that no task holds more than SPLIT pairs of blocks.

Defined cases: a vector that is null, or holds null or non-finite entries, is dropped; an entry of FAR or more has no exact
x and counts as non-finite. Vectors of another length than the most frequent one (of equally frequent the longest) have no
covariance with the rest and are dropped too; an empty table, and one whose vectors are empty, gives an empty result.
Repeated rows count and are returned as often as they stand there; a null vec_id stays null. A component without variance
(an eigenvalue that rounding can't tell from 0) has a null `whitened`, as have all where no vector differs; `explained` is
null where there is no variance at all, and `identity_error` is over the components that have some, null if none has. A
deviation that a long can't hold is null. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries beyond this size have no exact whole number.
FAR = float(1 << 38)
#: Columns of a block; fewest and most rows of one; number of blocks a column that rows aim at; blocks of a part of the
#: inner dimension.
COLUMNS, FEWEST, MOST, BLOCKS, SPLIT = 1024, 1024, 16_384, 1 << 17, 16


def block_rows(n: int) -> int:
    return int(min(MOST, max(FEWEST, -(-n // BLOCKS))))


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, x, index: the valid vectors as whole numbers, numbered from 0 on; written once."""
    usable = vectors.select(F.col(key).alias("key"), F.transform(vector, lambda c: c.cast("double")).alias("v")).where("v is not null")
    usable = usable.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < FAR)))
    rows = usable.select("key", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"), F.size("v").alias("dims"))
    rows = common.settled(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "whole-vectors")
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).limit(1).collect()
    dims = sizes[0]["dims"] if sizes else 0
    if rows.where(F.col("dims") != dims).limit(1).count():
        rows = common.settled(rows.where(F.col("dims") == dims).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "whole-vectors")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part of the written table
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(F.broadcast(starts.select("part", "start")), "part").select("key", "x", "dims", (F.col("start") + F.col("at")).alias("index"))


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, n = None, 0
    for batch in batches:
        if batch.num_rows:
            own = _lists(batch.column("x")).sum(axis=0).astype(object)  # whole numbers of any size across batches
            sums, n = own if sums is None else sums + own, n + batch.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums)), pa.int32()), pa.array([str(n), *map(str, sums)], pa.string())], ["i", "s"])


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""
    found = rows.select("x").mapInArrow(_part_sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by_place = {r["i"]: int(r["s"]) for r in found}
    return by_place.pop(-1, 0), [by_place[i] for i in sorted(by_place)]


def deviations(rows: DataFrame, n: int, total: list[int]) -> DataFrame:
    """index, key, deviation: the sum over dimensions of (n x - S) squared, exact."""
    target = np.array(total, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lists(batch.column("x")) if batch.num_rows else np.zeros((0, len(total)), np.int64)
            size = int(np.abs(x).max(initial=0))
            most = n * size + max(map(abs, total), default=0)
            if most < 1 << 62:
                gap = x * n - target.astype(np.int64)
                most = int(np.abs(gap).max(initial=0))
            if most * most * max(1, len(total)) < 1 << 63:
                own = (gap * gap).sum(axis=1).tolist()
            else:
                own = [sum(g * g for g in row) for row in (x.astype(object) * n - target).tolist()]
            own = [d if d < 1 << 63 else None for d in own]
            yield pa.RecordBatch.from_arrays([batch.column("index"), batch.column("key"), pa.array(own, pa.int64())], ["index", "key", "deviation"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("index", "key", "x").mapInArrow(run, f"index long, key {kind}, deviation long")


def centred(rows: DataFrame, n: int, total: list[int]) -> BlockMatrix:
    """The rows less their mean as distributed blocks."""
    mean = F.lit([s / n for s in total])
    ready = rows.select("index", array_to_vector(F.zip_with("x", mean, lambda x, m: x - m)).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(ready, "vector"), n, len(total))
    return indexed.toBlockMatrix(block_rows(n), min(COLUMNS, len(total)))


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix. The inner dimension, the table's rows, is dealt in parts of SPLIT blocks whose
    products are summed; the Python form of `multiply` has no such parameter."""
    parts = max(1, -(-blocks.numRowBlocks // SPLIT))
    java = blocks.transpose()._java_matrix_wrapper._java_model.multiply(blocks._java_matrix_wrapper._java_model, parts)
    found = BlockMatrix(java, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()
    return (found + found.T) / 2


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit eigenvectors as columns; 0 for what is rounding alone."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    noise = np.finfo(float).eps * len(covariance) * max(0.0, float(np.trace(covariance)))
    return np.where(values > noise, values, 0.0), vectors


def projected(blocks: BlockMatrix, whitening: np.ndarray) -> DataFrame:
    """index, p: the rows times the whitening matrix, as a block product."""
    k, width = whitening.shape[1], blocks.colsPerBlock
    context = blocks.blocks.context
    pieces = [((i, 0), Matrices.dense(len(w), k, w.ravel(order="F").tolist())) for i, w in enumerate(np.split(whitening, range(width, len(whitening), width)))]
    product = blocks.multiply(BlockMatrix(context.parallelize(pieces, len(pieces)), width, k, len(whitening), k))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("p"))


def identity_error(rows: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the projected rows' covariance, taken about their mean, minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if not pairs:
        return None
    found = rows.agg(*[F.covar_pop(F.get("p", F.lit(i)), F.get("p", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(vectors: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each valid vector and component."""
    rows = whole(vectors, key, vector)
    kind = vectors.schema[key].dataType.simpleString()
    n, total = sums(rows)
    if not n or not total:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    blocks = centred(rows, n, total)
    covariance = scatter(blocks) / n
    values, axes = components(covariance, most)
    trace = float(np.trace(covariance))
    some = int((values > 0).sum())
    apart = deviations(rows, n, total)
    if some:
        placed = common.settled(projected(blocks, axes[:, :some] / np.sqrt(values[:some])), "whitened")
        error = identity_error(placed, some)
        found = apart.join(placed, "index")
    else:
        error, found = None, apart.withColumn("p", F.array().cast("array<double>"))
    explained = F.lit([float(v) / trace for v in values] if trace > 0 else [None] * len(values)).cast("array<double>")
    each = found.select("key", "deviation", "p", F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))).alias("c"))
    return each.select(
        F.col("key").alias(key), (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("p", F.col("c")).alias("whitened"), F.get(explained, F.col("c")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(common.table(spark, sf_dir, "embeddings"))
