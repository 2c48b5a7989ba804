"""Stored tables that change: merges by key, versions, batches that count once, compaction.

A table is a folder of Parquet folders, one for each commit and partition, and of numbered manifests that list the folders
of a version. A merge finds the folders in which arriving keys live, from the key column and the file names alone, writes
those folders anew with the changes and appends new keys; all other folders pass into the next version as they are. A
manifest is created only if no other writer has created that version; readers see a version as a whole or not at all.
A writer's batches are numbered: a batch that came before changes nothing, so a sink may repeat it.

Manifests hold a line a folder and no rows. Keys are unique. Columns that arrive for the first time are added, empty in
older rows. A null key never matches and is refused. Values that arrive as null leave what is there.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "__commit"


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


class Conflict(Exception):
    """Another writer has committed the version first."""


class StoredTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, the last by default."""
        if version is None:
            found = self.versions()
            if not found:
                raise FileNotFoundError(f"no table in {self.path}")
            version = found[-1]
        stream = self._files.open(self._path(f"{self.path}/manifest/v{version:010d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        at = self._path(f"{self.path}/manifest/v{manifest['version']:010d}.json")
        draft = self._path(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        # A rename onto a name that is there fails or, on some stores, replaces: the check before narrows that, a store
        # with conditional writes closes it.
        if self._files.exists(at) or not self._files.rename(draft, at):
            self._files.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there")
        return manifest["version"]

    def exists(self) -> bool:
        return bool(self.versions())

    # Reading

    def _schema(self, manifest: dict) -> T.StructType:
        return T.StructType.fromJson(manifest["schema"])

    def _read(self, manifest: dict, folders: list[str]) -> DataFrame:
        schema = self._schema(manifest)
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn(COMMIT, F.lit(""))
        whole = T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())])
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default; filters on partition columns prune folders."""
        manifest = self.manifest(version)
        return self._read(manifest, manifest["folders"]).select(*_quoted(self._schema(manifest).fieldNames()))

    def history(self) -> DataFrame:
        """version, operation, folders, written, writer, batch."""
        rows = [(m["version"], m["operation"], len(m["folders"]), m["written"], m.get("writer"), m.get("batch")) for m in map(self.manifest, self.versions())]
        return self.spark.createDataFrame(rows, "version int, operation string, folders int, written int, writer string, batch long")

    # Writing

    def _write(self, rows: DataFrame, partitions: list[str]) -> list[str]:
        """Rows as a new commit; the folders that it made."""
        commit = f"{COMMIT}={uuid.uuid4().hex}"
        out = rows.write
        if partitions:
            out = rows.repartition(*partitions).write.partitionBy(*partitions)
        out.parquet(f"{self.path}/data/{commit}")
        found = [self._path(f"{self.path}/data/{commit}")]
        for _ in partitions:
            found = [f.getPath() for p in found for f in self._files.listStatus(p) if f.isDirectory() and "=" in f.getPath().getName()]
        base = self._files.makeQualified(self._path(f"{self.path}/data")).toString() + "/"
        return sorted(self._files.makeQualified(p).toString().removeprefix(base) for p in found)

    def create(self, rows: DataFrame, key: str, partitions: list[str] | None = None) -> int:
        partitions = partitions or []
        ordered = [c for c in rows.columns if c not in partitions] + partitions
        schema = rows.select(*_quoted(ordered)).schema
        folders = self._write(rows, partitions)
        return self._commit({"version": 0, "operation": "create", "key": key, "partitions": partitions, "schema": json.loads(schema.json()), "folders": folders, "written": len(folders), "writers": {}})

    def folders_of(self, manifest: dict, keys: DataFrame) -> tuple[DataFrame, list[str]]:
        """The given keys that are there, and the folders they live in; reads no other column."""
        key = manifest["key"]
        depth = len(manifest["partitions"]) + 1
        at = F.regexp_extract(F.col("_metadata.file_path"), "/((?:[^/]+/){%d})[^/]+$" % depth, 1)
        if not manifest["folders"]:
            return keys.select(key).limit(0), []
        held = self._read(manifest, manifest["folders"]).select(key, at.alias("__folder")).join(keys.select(key), key)
        folders = [unquote(r[0]).rstrip("/") for r in held.select("__folder").distinct().collect()]
        return held.select(key).distinct(), sorted(folders)

    def merge(self, arriving: DataFrame, insert: bool = True, order: str | None = None, writer: str | None = None, batch: int | None = None) -> int:
        """A new version in which arriving rows (the key and any columns) have overwritten what they have no null for and,
        with `insert`, new keys are added. Of several rows of a key the one with the greatest `order` counts, else the
        greatest row. Returns the version that holds the batch, which is an older one if the batch came before."""
        old = self.manifest()
        if writer is not None and batch is not None and old["writers"].get(writer, -1) >= batch:
            return old["version"]
        key, partitions, schema = old["key"], old["partitions"], self._schema(old)
        rank = F.struct(*([F.col(f"`{order}`").alias("__order")] if order else []), *_quoted(arriving.columns))
        one = arriving.groupBy(key).agg(F.max(rank).alias("__row")).select(*[F.col("__row").getField(c).alias(c) for c in arriving.columns])
        one = one.where(F.assert_true(F.col(key).isNotNull(), "a key is null").isNull())
        added = [f for f in one.schema.fields if f.name not in schema.fieldNames()]
        if added:
            schema = T.StructType([f for f in schema.fields if f.name not in partitions] + [T.StructField(f.name, f.dataType, True) for f in added] + [schema[p] for p in partitions])
        held, folders = self.folders_of(old, one)
        named = one.select(key, *[F.col(f"`{c}`").alias(f"__new_{c}") for c in one.columns if c != key])
        changed = lambda f: (F.coalesce(F.col(f"`__new_{f.name}`").cast(f.dataType), F.col(f"`{f.name}`")) if f.name in one.columns and f.name != key else F.col(f"`{f.name}`")).alias(f.name)
        rows = self._read({**old, "schema": json.loads(schema.json())}, folders).join(named, key, "left").select(*[changed(f) for f in schema.fields])
        if insert:
            given = lambda f: (F.col(f"`{f.name}`").cast(f.dataType) if f.name in one.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            rows = rows.unionByName(one.join(held, key, "left_anti").select(*[given(f) for f in schema.fields]))
        made = self._write(rows, partitions)
        writers = old["writers"] | ({writer: batch} if writer is not None and batch is not None else {})
        return self._commit({**old, "version": old["version"] + 1, "operation": "merge" if insert else "update", "schema": json.loads(schema.json()), "folders": sorted(set(old["folders"]) - set(folders) | set(made)), "written": len(made), "writers": writers, "writer": writer, "batch": batch})

    def update(self, arriving: DataFrame, **options) -> int:
        """Like `merge`, for keys that are there only."""
        return self.merge(arriving, insert=False, **options)

    def delete(self, keys: DataFrame) -> int:
        """A new version without the given keys; only the folders that hold them are written anew."""
        old = self.manifest()
        _, folders = self.folders_of(old, keys)
        made = self._write(self._read(old, folders).join(keys.select(old["key"]), old["key"], "left_anti").select(*_quoted(self._schema(old).fieldNames())), old["partitions"])
        return self._commit({**old, "version": old["version"] + 1, "operation": "delete", "folders": sorted(set(old["folders"]) - set(folders) | set(made)), "written": len(made), "writer": None, "batch": None})

    def compact(self, most: int = 1) -> int:
        """A new version with one folder for each partition that had more than `most`."""
        old = self.manifest()
        by_partition: dict[str, list[str]] = {}
        for f in old["folders"]:
            by_partition.setdefault(f.partition("/")[2], []).append(f)
        crowded = [f for folders in by_partition.values() if len(folders) > most for f in folders]
        made = self._write(self._read(old, crowded).select(*_quoted(self._schema(old).fieldNames())), old["partitions"]) if crowded else []
        return self._commit({**old, "version": old["version"] + 1, "operation": "compact", "folders": sorted(set(old["folders"]) - set(crowded) | set(made)), "written": len(made), "writer": None, "batch": None})

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests before the last `keep` versions and folders that none of these lists; returns how many folders
        went. Not for tables with a writer at work, whose folders aren't listed yet."""
        versions = self.versions()
        kept = {f for v in versions[-keep:] for f in self.manifest(v)["folders"]}
        gone = {f for v in versions[:-keep] for f in self.manifest(v)["folders"]} - kept
        for f in gone:
            self._files.delete(self._path(f"{self.path}/data/{f}"), True)
        for v in versions[:-keep]:
            self._files.delete(self._path(f"{self.path}/manifest/v{v:010d}.json"), False)
        return len(gone)
