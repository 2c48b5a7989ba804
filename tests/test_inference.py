"""A toy model over texts: calls, faults, failing rows and resumed runs."""

import os

import pytest

from rostrum.operators import inference
from rostrum.sources.store import fresh_path


def loader(log, broken=None):
    def load():
        with open(f"{log}/loads", "a") as f:
            f.write("x")

        def model(texts):
            if any(t == "poison" for t in texts):
                raise ValueError("no poison")
            if broken and os.path.exists(broken) and any(t.endswith("7") for t in texts):
                os._exit(1)  # the worker dies, as one out of memory does
            with open(f"{log}/calls", "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return [t.upper() for t in texts]

        return model

    return load


def calls(log):
    return sorted(open(f"{log}/calls").read().split("\n")[:-1]) if os.path.exists(f"{log}/calls") else []


def test_resumes_after_a_fault(spark, tmp_path):
    texts = [f"text {i}" for i in range(60)] + ["poison", "text 3", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").repartition(4)
    want = {i: (None if t in ("poison", None) else t.upper(), "ValueError: no poison" if t == "poison" else None) for i, t in enumerate(texts)}
    path, broken = fresh_path(spark, "model"), f"{tmp_path}/broken"
    open(broken, "w").close()
    run = lambda **o: {r["id"]: (r["result"], r["error"]) for r in inference.with_model(docs, "body", loader(tmp_path, broken), path, "v1", batch=5, flush=9, **o).collect()}
    with pytest.raises(Exception):  # noqa: B017
        run()
    os.remove(broken)
    kept = inference.StoredTable(spark, path).read().count()
    asked = len(calls(tmp_path))
    assert run() == want
    # The poison may be among what was kept; whatever was kept isn't asked again.
    assert len(calls(tmp_path)) - asked in (60 - kept, 61 - kept)
    before = len(calls(tmp_path))
    assert run() == want and len(calls(tmp_path)) == before  # nothing is left to ask
    assert run(retry=True) == want and len(calls(tmp_path)) == before  # only the poison was asked again
    clean = {r["id"]: (r["result"], r["error"]) for r in inference.with_model(docs, "body", loader(tmp_path), fresh_path(spark, "model"), "v1").collect()}
    assert clean == want


def test_answers():
    bad = lambda texts: (_ for _ in ()).throw(KeyError("b")) if "b" in texts else [t * 2 for t in texts]
    assert inference.answers(bad, ["a", "b", "c"]) == [("aa", None), (None, "KeyError: 'b'"), ("cc", None)]
    assert inference.answers(lambda texts: [], ["a"])[0][1].startswith("ValueError: 0 results")
    assert inference.answers(lambda texts: [], []) == []


def test_versions_and_empty(spark, tmp_path):
    path = fresh_path(spark, "model")
    docs = spark.createDataFrame([(1, "a")], "id long, body string")
    assert inference.with_model(docs.limit(0), "body", loader(tmp_path), path, "v1").count() == 0
    for version in ("v1", "v2"):
        assert inference.with_model(docs, "body", loader(tmp_path), path, version).first()["result"] == "A"
    assert calls(tmp_path) == ["a", "a"]
