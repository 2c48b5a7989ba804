"""Sketch cubes, documents with differing fields and exact percentiles against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import search, selection, sketches
from rostrum.sources import documents, fixtures
from rostrum.sources.store import fresh_path

SPEECH = "term int, year int, session_id string, speech_giver string, topic_id int, political_party_at_time string, province string"


def test_cubes_merge_and_stay_near(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(17, 20)), int(rng.integers(1, 4)), f"s{rng.integers(9000)}", f"m{rng.integers(20000)}", int(rng.integers(-1, 30)) if rng.random() > 0.1 else None, f"p{rng.integers(9)}" if rng.random() > 0.2 else None, f"q{rng.integers(20)}") for _ in range(30000)]
    frame = spark.createDataFrame(rows, SPEECH)
    halves = [sketches.cube(frame.where(f"term {op} 17"), "term", "year") for op in ("=", ">")]
    cells = sketches.merged(halves[0].unionByName(halves[1]), "term", "year")
    for keep in ("true", "term > 17", "year = 2"):
        own = [r for r in rows if keep == "true" or (r[0] > 17 if keep.startswith("term") else r[1] == 2)]
        found = sketches.index_stats(cells.where(keep)).first()
        for name, want in (("sessions", {r[2] for r in own}), ("members", {r[3] for r in own}), ("topics", {r[4] for r in own} - {None, -1, 1})):
            assert abs(found[name] - len(want)) <= 0.02 * len(want)
        assert found["speeches"] == len(own) and found["first_term"] == min(r[0] for r in own)
        parties = [r[5] for r in own if r[5]]
        assert dict(map(tuple, sketches.top_values(cells.where(keep), "political_party_at_time", 99).collect())) == {p: parties.count(p) for p in set(parties)}
    none = sketches.index_stats(cells.where("term > 99")).first()
    assert (none["speeches"], none["members"], none["first_term"]) == (0, 0, None)


TEXTS = ['{"a":1,"b":[{"c":1.5,"d e":null},true,[]],"x.y":"s"}', '{"a":"q","e":{}}', "[1,2]", "3", "null", "bad{", "", None, '{"a":1}']


def plain_report(texts):
    seen = {}

    def walk(i, x, path):
        kind = "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "number"
        seen.setdefault((path, kind), []).append(i)
        if isinstance(x, dict):
            for k, v in x.items():
                walk(i, v, f"{path}.{k}" if k.isidentifier() else f'{path}."{k}"')
        if isinstance(x, list):
            for v in x:
                walk(i, v, path + "[]")

    for i, t in enumerate(texts):
        try:
            if t is not None:
                walk(i, json.loads(t), "$")
        except ValueError:
            seen.setdefault(("$", "malformed"), []).append(i)
    return sorted((*k, len(set(v)), len(v)) for k, v in seen.items())


def test_documents(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, doc string")
    assert sorted(map(tuple, documents.field_report(frame, "id", "doc").collect())) == plain_report(TEXTS)
    assert documents.field_report(frame.limit(0), "id", "doc").count() == 0
    assert [r["id"] for r in documents.first_with(frame, "id", "doc", ["$.a", "$.b[0].c"]).collect()] == [0]
    assert documents.first_with(frame, "id", "doc", ['$.b[0]["d e"]']).count() == 0 and documents.first_with(frame, "id", "doc", ["$.zz"]).count() == 0
    path = fresh_path(spark, "backup")
    documents.backup(frame, "id", "doc", path)
    back = {r["key"]: json.loads(r["text"]) for r in documents.restore(spark, path).collect() if r["text"] is not None}
    assert back == {i: json.loads(t) for i, t in enumerate(TEXTS) if i in (0, 1, 2, 3, 8)} | ({4: None} if 4 in back else {})


@pytest.mark.parametrize("part", [0.0, 0.37, 0.8, 1.0])
def test_percentiles(spark, monkeypatch, part):
    """Small bounds, so that brackets are narrowed for real; one group holds nearly all rows."""
    for name, value in (("STEPS", 8), ("ACCURACY", 64), ("FEW", 5)):
        monkeypatch.setattr(selection, name, value)
    rng = np.random.default_rng(3)
    groups = {"all": np.r_[rng.normal(size=3000), rng.normal(size=500) * 1e6], "ties": rng.integers(0, 4, 400).astype(float), None: np.array([2.0, 1.0]), "one": np.array([7.5])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("all", None), ("none", None), ("all", float("nan"))]
    got = {r["g"]: r["cut"] for r in selection.exact_percentile(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", part).collect()}
    assert got.keys() == groups.keys()
    assert all(abs(got[g] - np.quantile(v, part)) <= 1e-12 * max(1, abs(got[g])) for g, v in groups.items())


def test_speech_table_follows_its_sources(spark, tmp_path):
    """A changed source table is derived anew, an unchanged one is read as stored."""
    given = "/root/testdata/sf0.001"
    for name in fixtures.SOURCES:
        spark.read.parquet(f"{given}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = fixtures.speeches(spark, str(tmp_path))
    assert fixtures.speeches(spark, str(tmp_path)).inputFiles() == first.inputFiles()
    n = first.count()
    spark.read.parquet(f"{given}/orders.parquet").limit(10).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert fixtures.speeches(spark, str(tmp_path)).count() == n + 10


def test_deep_pages(spark, monkeypatch):
    """Pages by ranges are those of a plain sort, with descending and null keys; the last page may be short or empty."""
    rows = [(i, None if i % 50 == 0 else i % 7, f"t{i}") for i in range(503)]
    frame = spark.createDataFrame(rows, "id long, k int, t string").repartition(5)
    order = [F.col("k").desc_nulls_last(), F.col("id")]
    plain = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    monkeypatch.setattr(search, "SHALLOW", 20)
    for start, size in ((0, 20), (10, 20), (250, 40), (500, 20), (600, 20)):
        assert [tuple(r) for r in search.page(frame, order, size, start).collect()] == plain[start : start + size]
    assert [tuple(r) for r in search.clamped_page(frame, order, 10**9, 25).collect()] == plain[500:]
    assert search.clamped_page(frame.where("false"), order, 3, 25).collect() == []
