"""Tables as streams: one file, or a folder of part files."""

import pytest

from rostrum.plans import QUERIES
from rostrum.streaming import stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("files", [1, 3])
def test_one_file_or_a_folder(spark, tmp_path, files):
    """Part files lie in a folder of the table's name; X7 gives the same rows from them as from one file."""
    whole = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole.repartition(files).write.parquet(f"{tmp_path}/embeddings.parquet")
    stream.run_once(stream.arriving(spark, str(tmp_path), "embeddings").select("vec_id"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == whole.count()
    rows = lambda d: sorted(map(tuple, QUERIES["X7_stream_topics"](spark, d).collect()))
    assert rows(str(tmp_path)) == rows(SF)
