"""Stored tables: merges touch only the folders that hold the keys, batches count once, versions stay."""

import os

import pytest
from pyspark.sql import functions as F

from rostrum.sources.store import fresh_path
from rostrum.sources.versioned import Conflict, StoredTable

SCHEMA = "id long, name string, n int, `a.b` string, term int, town string"


def rows(n=60):
    return [(i, f"n{i}", i % 7 if i % 5 else None, "x", i % 3, ["Uşak/a", "b=c d", None][i % 3]) for i in range(n)]


@pytest.fixture
def made(spark):
    table = StoredTable(spark, fresh_path(spark, "stored-table"))
    table.create(spark.createDataFrame(rows(), SCHEMA), "id", ["term", "town"])
    return table


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(table.path + "/data") for f in names if f.endswith(".parquet")}


def content(df):
    return {r["id"]: tuple(r[c] for c in ("name", "n", "a.b", "term", "town")) for r in df.collect()}


START = {i: tuple(r) for i, *r in rows()}


def test_round_trip(made):
    assert content(made.read()) == START
    assert [f.name for f in made.read().schema.fields] == ["id", "name", "n", "a.b", "term", "town"]
    assert "PartitionFilters: [isnotnull(term" in made.read().where("term = 1")._jdf.queryExecution().toString()


def test_merge_writes_only_touched_partitions(spark, made):
    before, manifest = files(made), made.manifest()
    fresh = spark.createDataFrame([(3, "new", None, 0), (9, None, 99, 0), (600, "added", 5, 2)], "id long, name string, n int, term int")
    assert made.merge(fresh) == 1
    want = START | {3: ("new", *START[3][1:]), 9: (START[9][0], 99, *START[9][2:]), 600: ("added", 5, None, 2, None)}
    assert content(made.read()) == want and content(made.read(0)) == START
    now = made.manifest()
    stay = [f for f in manifest["folders"] if "/term=0" not in f]
    assert set(stay) < set(now["folders"]) and len(now["folders"]) == 4 and now["written"] == 2
    assert {f: t for f, t in files(made).items() if f in before} == before


def test_update_adds_no_keys_and_rows_can_move(spark, made):
    made.update(spark.createDataFrame([(3, 1), (700, 1)], "id long, term int"))
    want = START | {3: (*START[3][:3], 1, START[3][4])}
    assert content(made.read()) == want


def test_batches_count_once(spark, made):
    one = spark.createDataFrame([(1, "first")], "id long, name string")
    assert made.merge(one, writer="w", batch=4) == 1
    assert made.merge(spark.createDataFrame([(1, "again")], "id long, name string"), writer="w", batch=4) == 1
    assert made.merge(spark.createDataFrame([(1, "late")], "id long, name string"), writer="w", batch=3) == 1
    assert content(made.read())[1][0] == "first" and made.merge(one, writer="other", batch=0) == 2


def test_last_row_of_a_key_wins(spark, made):
    many = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 0)], "id long, name string, n int")
    made.merge(many, order="n")
    assert content(made.read())[1][:2] == ("a", 2)
    made.merge(many)
    assert content(made.read())[1][:2] == ("c", 0)


def test_new_columns(spark, made):
    made.merge(spark.createDataFrame([(2, [1.5]), (800, None)], "id long, vector array<double>"))
    got = {r["id"]: r["vector"] for r in made.read().collect()}
    assert got == dict.fromkeys([*START, 800]) | {2: [1.5]} and made.read(0).columns == ["id", "name", "n", "a.b", "term", "town"]


def test_delete_compact_and_vacuum(spark, made):
    made.delete(spark.createDataFrame([(i,) for i in range(0, 60, 3)], "id long"))
    assert set(content(made.read())) == {i for i in range(60) if i % 3} and len(made.manifest()["folders"]) == 2
    for i in range(3):
        made.merge(spark.createDataFrame([(900 + i, "x", 1, "b=c d")], "id long, name string, term int, town string"))
    now = content(made.read())
    assert len(made.manifest()["folders"]) == 5
    made.compact()
    assert content(made.read()) == now and len(made.manifest()["folders"]) == 2 and made.manifest()["written"] == 1
    assert [r["operation"] for r in made.history().orderBy("version").collect()] == ["create", "delete", "merge", "merge", "merge", "compact"]
    assert made.vacuum() == 5 and content(made.read()) == now and len(made.versions()) == 1


def test_conflict_and_null_keys(spark, made):
    with pytest.raises(Conflict):
        made.create(spark.createDataFrame(rows(3), SCHEMA), "id")
    with pytest.raises(Exception, match="a key is null"):
        made.merge(spark.createDataFrame([(None, "x")], "id long, name string"))
    assert made.versions() == [0]


def test_empty_and_unpartitioned(spark):
    table = StoredTable(spark, fresh_path(spark, "stored-table"))
    assert not table.exists()
    table.create(spark.createDataFrame([], SCHEMA), "id")
    assert table.read().count() == 0
    table.merge(spark.createDataFrame(rows(5), SCHEMA))
    assert content(table.read()) == {i: START[i] for i in range(5)}
    table.merge(table.read().select("id").limit(0).withColumn("name", F.lit("y")))
    assert content(table.read()) == {i: START[i] for i in range(5)}
