"""Topics that a stream founds: vectors near a known centre take its topic, others found topics that later ones join.

Known centres are matched without state. What matches none goes to a cell, that of its most similar known centre, parted
further by the signs of `bits` places' sums; a cell's founded topics are its state, as sums of their unit vectors, numbers of
members and last times. Within a batch a cell's vectors come in the order of time and key. A vector joins the most similar
founded topic of its cell at or above the threshold (of equally similar ones the older) and moves its sum, or founds one.

A topic expires: a vector later than its last member by more than `ttl` can't join it any more, and a timer drops it from the
state once the watermark has passed that time. Ids go on from the greatest known one; each cell has ids of its own, so cells
share none and need not ask each other. State lives in the checkpoint, so a restart goes on where the last run stopped. A cell's
vectors of one batch are in memory together, so the source's limits (maxFilesPerTrigger and the like) bound them.

Rows without key, time or a whole vector get no topic. RocksDB holds the state (`rocksdb_state` while the query starts).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rostrum.functions.vectors import dot, scaled
from rostrum.operators.topics import GROUP
from rostrum.sources.store import stored

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "key long, topic_id long, sim double, is_new boolean, members long"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The session's state store is RocksDB inside; what it was comes back after."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


class Founder(StatefulProcessor):
    def __init__(self, top: int, cells: int, threshold: float, ttl_ms: int):
        self.top, self.cells, self.threshold, self.ttl = top, cells, threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.topics = handle.getMapState("topics", "topic_id long", "total binary, n long, last long")
        self.founded = handle.getValueState("founded", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["ms", "key"])
        known = sorted((k[0], np.frombuffer(v[0]).copy(), v[1], v[2]) for k, v in self.topics.iterator())
        ids = [t[0] for t in known]
        totals = np.array([t[1] for t in known])
        n, last = [t[2] for t in known], np.array([t[3] for t in known], np.int64)
        count = self.founded.get()[0] if self.founded.exists() else 0
        before, changed, out = count, set(), []
        for k, ms, v in zip(arrived["key"], arrived["ms"], arrived["v"], strict=True):
            v = np.asarray(v, np.float64)
            sims = np.where(last + self.ttl >= ms, totals @ v / np.maximum(np.linalg.norm(totals, axis=1), 1e-300), -np.inf) if len(ids) else np.zeros(0)
            at = int(sims.argmax()) if len(sims) else -1
            fresh = at < 0 or sims[at] < self.threshold
            if fresh:
                at = len(ids)
                ids.append(self.top + 1 + int(key[0]) + self.cells * count)
                totals = np.vstack([totals, v]) if at else v[None].copy()
                n.append(1)
                last = np.r_[last, ms]
                count += 1
            else:
                totals[at] += v
                n[at] += 1
                last[at] = max(last[at], ms)
            changed.add(at)
            out.append((k, ids[at], None if fresh else float(sims[at]), fresh, n[at]))
        for at in sorted(changed):
            self.topics.updateValue((ids[at],), (totals[at].tobytes(), n[at], int(last[at])))
            self.handle.registerTimer(int(last[at]) + self.ttl + 1)
        if count > before:
            self.founded.update((count,))
        yield pd.DataFrame(out, columns=["key", "topic_id", "sim", "is_new", "members"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [k for k, v in self.topics.iterator() if v[2] + self.ttl < expiredTimerInfo.getExpiryTimeInMs()]
        for k in gone:
            self.topics.removeKey(k)
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "topic_id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64"), "is_new": pd.Series(dtype="bool"), "members": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def founded_topics(stream: DataFrame, centers: DataFrame, key: str, vector: str = "embedding", time: str = "ts", threshold: float = 0.7, ttl: str = "30 days", late: str = "0 seconds", bits: int = 0) -> DataFrame:
    """key, topic_id, sim, is_new, members of the founded topic so far (null for a known one) for each arriving row. centers:
    topic_id, centroid, at most GROUP rows, since each task holds them. Append mode."""
    spark = stream.sparkSession
    centers = stored(centers.select("topic_id", "centroid").where("topic_id is not null and centroid is not null"), "centres")
    size = centers.agg(F.count("*").alias("n"), F.max("topic_id").alias("top")).first()
    if size["n"] > GROUP:
        raise ValueError(f"more than {GROUP} known centres: match them batch by batch (stream.topic_sink)")
    top = -1 if size["top"] is None else int(size["top"])
    row = centers.agg(F.array_sort(F.collect_list(F.struct("topic_id", scaled(F.col("centroid")).alias("c")))).alias("__all"))
    ttl_ms = spark.sql(f"SELECT CAST(unix_millis(timestamp_millis(0) + INTERVAL {ttl}) AS BIGINT) AS ms").first()["ms"]
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(time).alias("ts"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withWatermark("ts", late).withColumn("v", scaled(F.col("v"))).crossJoin(F.broadcast(row))
    found = F.array_max(F.transform("__all", lambda c, i: F.struct(dot(F.col("v"), c["c"]).alias("sim"), (-i).alias("place"))))
    rows = rows.withColumn("found", found)
    place = F.coalesce(-F.col("found.place"), F.lit(0))
    known = F.coalesce(F.col("found.sim") >= threshold, F.lit(False))
    total = lambda b: F.aggregate(F.filter("v", lambda _, i: i % bits == b), F.lit(0.0), lambda s, x: s + x)
    signs = F.lit(0)
    for b in range(bits):
        signs = signs * 2 + F.when(total(b) >= 0, 1).otherwise(0)
    cells = max(1, size["n"]) << bits
    matched = rows.where(known).select("key", F.element_at("__all", (place + 1).cast("int"))["topic_id"].cast("long").alias("topic_id"), F.col("found.sim").alias("sim"), F.lit(False).alias("is_new"), F.lit(None).cast("long").alias("members"))
    open_ = rows.where(~known).select(((place * (1 << bits)) + signs).cast("long").alias("cell"), "key", "ts", F.unix_millis("ts").alias("ms"), "v")
    fresh = open_.groupBy("cell").transformWithStateInPandas(Founder(top, cells, threshold, ttl_ms), OUT, "append", "eventtime")
    return matched.unionByName(fresh).withColumnRenamed("key", key)
