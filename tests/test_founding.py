"""Founded topics over several runs of a stream against a plain loop over the batches."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from rostrum.streaming import founding, stream

DAY = 86_400_000
START = dt.datetime(2020, 1, 1)


def batches(seed=4, dims=4):
    rng = np.random.default_rng(seed)
    aims, out, key = rng.normal(size=(5, dims)), [], 0
    for b in range(3):
        rows = []
        for _ in range(25):
            v = aims[int(rng.integers(5))] + rng.normal(size=dims) * 0.25
            rows.append((key, START + dt.timedelta(days=b * 20 + int(rng.integers(15)), seconds=key), v.tolist()))
            key += 1
        out.append([rows[i] for i in rng.permutation(len(rows))])
    out[1] += [(1000, START + dt.timedelta(days=30), None), (1001, START + dt.timedelta(days=30), [float("nan")] * dims), (None, START + dt.timedelta(days=30), [1.0] * dims)]
    return out


def plain(arriving, centers, threshold, ttl_days):
    """Topics of a cell by hand: cosine with the sum of unit vectors, the older of equal ones."""
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    known = sorted((t, unit(c)) for t, c in centers)
    top, cells, out = known[-1][0], {}, {}
    for rows in arriving:
        todo = {}
        for k, ts, v in rows:
            if k is None or v is None or not np.isfinite(v).all():
                continue
            sims = [float(unit(v) @ c) for _, c in known]
            best = int(np.argmax(sims))
            if sims[best] >= threshold:
                out[k] = (known[best][0], False, None)
            else:
                todo.setdefault(best, []).append((ts, k, unit(v)))
        for cell, own in todo.items():
            topics = cells.setdefault(cell, [])
            for ts, k, v in sorted(own, key=lambda r: r[:2]):
                able = [(float(v @ unit(t["sum"])), -i) for i, t in enumerate(topics) if t["last"] + dt.timedelta(days=ttl_days) >= ts]
                s, i = max(able, default=(-2, 0))
                if s >= threshold:
                    t = topics[-i]
                    t["sum"], t["n"], t["last"] = t["sum"] + v, t["n"] + 1, max(t["last"], ts)
                    out[k] = (t["id"], False, t["n"])
                else:
                    topics.append({"id": top + 1 + cell + len(known) * len(topics), "sum": v, "n": 1, "last": ts})
                    out[k] = (topics[-1]["id"], True, 1)
    return out


def test_three_runs_equal_a_plain_loop(spark, tmp_path):
    """Each run starts a new query on the checkpoint of the last one."""
    arriving = batches()
    centers = [(3, np.eye(4)[0].tolist()), (7, np.eye(4)[1].tolist())]
    known = spark.createDataFrame(centers, "topic_id int, centroid array<double>")
    schema, source = "vec_id long, ts timestamp, embedding array<double>", f"{tmp_path}/in"
    for ttl in (400, 12):
        out, check = f"{tmp_path}/out{ttl}", f"{tmp_path}/check{ttl}"
        for b, rows in enumerate(arriving):
            if ttl == 400:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            if ttl == 400 or b == 2:  # one run a batch, and once all batches in one run
                with founding.rocksdb_state(spark):
                    stream.run_once(founding.founded_topics(files, known, "vec_id", threshold=0.8, ttl=f"{ttl} days"), out, check)
        got = {r["vec_id"]: (r["topic_id"], r["is_new"], r["members"]) for r in spark.read.parquet(out).collect()}
        assert got == plain(arriving, centers, 0.8, ttl)
        assert sum(new for _, new, _ in got.values()) > 4 and max(n or 0 for *_, n in got.values()) > 2


def test_bits_part_cells(spark, tmp_path):
    rows = [(i, START, v) for i, v in enumerate([[1.0, 1.0], [1.0, -1.0], [-1.0, -1.0], [1.0, 0.9]])]
    spark.createDataFrame(rows, "k long, ts timestamp, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/in")
    files = spark.readStream.schema("k long, ts timestamp, embedding array<double>").parquet(f"{tmp_path}/in")
    none = spark.createDataFrame([], "topic_id int, centroid array<double>")
    with founding.rocksdb_state(spark):
        stream.run_once(founding.founded_topics(files, none, "k", threshold=0.9, bits=2), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {r["k"]: r["topic_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: 3, 1: 2, 2: 0, 3: 3} and spark.read.parquet(f"{tmp_path}/out").where(F.col("is_new")).count() == 3
