"""A model over texts in batches: loaded once a worker, resumed by digests of what is done, failing rows set aside.

The model is any function from a list of texts to a list of results; `load` makes it on the worker. Results live in a stored
table by the digest of version and text, so equal texts are asked once, a new version starts anew, and a run that breaks off
loses only the flush it was in: every `flush` texts are a commit. A batch that raises is halved until the failing text stands
alone; that text gets the error instead of a result and the others get theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.sources.store import stored
from rostrum.sources.versioned import StoredTable

Model = Callable[[list[str]], list[str | None]]
#: Texts of a call, and about how many become a commit.
BATCH, FLUSH = 32, 100_000
_models: dict[str, Model] = {}


def answers(model: Model, texts: list[str]) -> list[tuple[str | None, str | None]]:
    """A result and no error, or an error and no result, for each text."""
    try:
        found = model(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return [(r, None) for r in found]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return answers(model, texts[:half]) + answers(model, texts[half:])


def _asked(load: Callable[[], Model], version: str, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows and version not in _models:
                _models.clear()
                _models[version] = load()
            texts, out = rows.column("text").to_pylist(), []
            for at in range(0, len(texts), batch):
                out += answers(_models[version], texts[at : at + batch])
            yield pa.RecordBatch.from_arrays([rows.column("digest"), pa.array([r for r, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], ["digest", "result", "error"])

    return run


def with_model(docs: DataFrame, text: str, load: Callable[[], Model], path: str, version: str, batch: int = BATCH, flush: int = FLUSH, retry: bool = False) -> DataFrame:
    """docs with result and error. path: the folder of the results' table, made at the first run. A null text isn't asked and
    has neither. With `retry`, texts that failed before are asked again."""
    spark = docs.sparkSession
    done = StoredTable(spark, path)
    if not done.exists():
        done.create(spark.createDataFrame([], "digest string, result string, error string"), "digest")
    digest = F.sha2(F.concat(F.lit(f"{version}\n"), F.col(text)), 256)
    known = done.read().where("error is null") if retry else done.read()
    wanted = docs.where(F.col(text).isNotNull()).select(digest.alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
    open_ = stored(wanted.join(known.select("digest"), "digest", "left_anti"), "asked")
    parts = -(-open_.count() // flush)
    for part in range(parts):
        now = open_.where(F.pmod(F.xxhash64("digest"), F.lit(parts)) == part) if parts > 1 else open_
        # Answers are written before they are merged, so that no text is asked twice.
        done.merge(stored(now.mapInArrow(_asked(load, version, batch), "digest string, result string, error string"), "answers"))
    found = done.read().select(F.col("digest").alias("__digest"), "result", "error")
    return docs.withColumn("__digest", digest).join(found, "__digest", "left").drop("__digest")
