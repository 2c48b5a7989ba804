"""Anti-entropy between stored copies: trees of digests say which buckets differ, only those are read and joined.

Rows lie in buckets by a hash of their key, a folder of the stored table for each bucket. A leaf of the tree is the digest of
a bucket's rows that have one of the synced fields, of key and fields alone and in no order; a node digests its FAN children,
the root all. Leaves are kept beside the rows and taken anew only for buckets that a merge touched.

`pull` descends both trees where they differ, reads these buckets on either side, and merges rows whose fields differ. Fields
that are null in the source stay as they are in the copy, as do keys that the source lacks; such rows keep the roots apart and
are counted (`extra`), so equal roots prove equal fields, and without extra rows they have to be equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.sources.store import stored
from rostrum.sources.versioned import StoredTable

LEAVES, FAN = 256, 16


class Replica:
    """A stored table of rows by bucket, and the digests of its buckets."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str], leaves: int = LEAVES):
        self.spark, self.key, self.fields, self.n_leaves = spark, key, fields, leaves
        self.rows, self.leaves = StoredTable(spark, f"{path}/rows"), StoredTable(spark, f"{path}/leaves")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.n_leaves)).cast("int"))

    def _digests(self, rows: DataFrame) -> DataFrame:
        """bucket, n, digest; sums and exclusive ors of two hashes don't depend on the order of rows."""
        some = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in self.fields])
        # A null field has to differ from one that isn't there, so its place is hashed too.
        whole = [self.key, *[x for f in self.fields for x in (F.col(f).isNull(), F.col(f))]]
        one, two = F.xxhash64(*whole), F.xxhash64(F.lit(17), *whole)
        grouped = rows.groupBy("bucket").agg(F.count_if(some).alias("n"), F.bit_xor(F.when(some, one)).alias("x"), F.sum(F.when(some, two.cast("decimal(20,0)"))).alias("s"))
        return grouped.select("bucket", "n", F.sha2(F.concat_ws(":", "n", "x", "s"), 256).alias("digest"))

    def create(self, rows: DataFrame) -> None:
        self.rows.create(self._bucketed(rows), self.key, ["bucket"])
        self.leaves.create(self._digests(self.rows.read()), "bucket")

    def merge(self, arriving: DataFrame, **options) -> None:
        """A merge into the rows, then the digests of the buckets that it touched."""
        arriving = stored(self._bucketed(arriving), "arriving")
        self.rows.merge(arriving, **options)
        touched = [r["bucket"] for r in arriving.select("bucket").distinct().collect()]
        if touched:
            self.leaves.merge(self._digests(self.rows.read().where(F.col("bucket").isin(touched))))

    def read(self) -> DataFrame:
        return self.rows.read().drop("bucket")

    def tree(self) -> list[DataFrame]:
        """node, digest of each level, leaves first; the last has one node, the root."""
        levels, size = [self.leaves.read().where("n > 0").select(F.col("bucket").alias("node"), "digest")], self.n_leaves
        while size > 1:
            size = -(-size // FAN)
            below = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws(":", c["node"], c["digest"])), ",")
            levels.append(levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("int").alias("parent")).agg(F.sha2(below, 256).alias("digest")).withColumnRenamed("parent", "node"))
        return levels

    def root(self) -> str | None:
        found = self.tree()[-1].first()
        return found["digest"] if found else None

    def differing(self, other: Replica) -> list[int]:
        """Buckets whose digests differ, found from the root down: below equal nodes nothing is compared."""
        mine, theirs = self.tree(), other.tree()
        nodes = None
        for own, its in zip(reversed(mine), reversed(theirs), strict=True):
            if nodes is not None:
                own, its = (level.where(F.floor(F.col("node") / FAN).isin(nodes)) for level in (own, its))
            apart = own.alias("a").join(its.alias("b"), "node", "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
            nodes = sorted(r["node"] for r in apart.select("node").collect())
            if not nodes:
                break
        return nodes

    def _bytes(self, buckets: list[int]) -> int:
        """Stored bytes of the buckets' folders."""
        wanted = {f"bucket={b}" for b in buckets}
        return sum(self.rows._files.getContentSummary(self.rows._path(f"{self.rows.path}/data/{f}")).getLength() for f in self.rows.manifest()["folders"] if f.rsplit("/", 1)[-1] in wanted)

    def pull(self, source: Replica) -> dict[str, int | bool]:
        """Takes over the source's fields where they differ. Returns buckets (that differed), read_bytes (of them, on both
        sides), changed (rows), extra (rows with fields in these buckets that the source has not) and equal (the roots)."""
        if self.n_leaves != source.n_leaves or self.fields != source.fields:
            raise ValueError("both copies need the same leaves and fields")
        buckets = self.differing(source)
        if not buckets:
            return {"buckets": 0, "read_bytes": 0, "changed": 0, "extra": 0, "equal": True}
        read = self._bytes(buckets) + source._bytes(buckets)
        key, fields = self.key, self.fields
        theirs = source.rows.read().where(F.col("bucket").isin(buckets)).select(key, *fields)
        mine = self.rows.read().where(F.col("bucket").isin(buckets)).select(key, *[F.col(f).alias(f"__old_{f}") for f in fields], F.lit(True).alias("__mine"))
        both = stored(theirs.withColumn("__theirs", F.lit(True)).join(mine, key, "full_outer"), "differing")
        news = reduce(lambda a, b: a | b, [F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"__old_{f}")) for f in fields])
        kept = reduce(lambda a, b: a | b, [F.col(f).isNull() & F.col(f"__old_{f}").isNotNull() for f in fields])
        changed = both.where(F.col("__theirs").isNotNull() & news).select(key, *fields)
        counts = both.agg(F.count_if(F.col("__theirs").isNotNull() & news).alias("changed"), F.count_if(F.col("__mine").isNotNull() & kept).alias("extra")).first()
        if counts["changed"]:
            self.merge(changed)
        return {"buckets": len(buckets), "read_bytes": read, "changed": counts["changed"], "extra": counts["extra"], "equal": self.root() == source.root()}
