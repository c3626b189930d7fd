import numpy as np
import pytest
from dialoom.sources.arrays import natural_order, read_npz, reassembled
from dialoom.streaming.ingest import run_available, transcript_stream
from pyspark.sql import functions as F


def test_npz(spark, tmp_path):
    np.savez_compressed(tmp_path / "d1.npz", A=np.array([1, 2], "i4"), B=np.zeros((2, 3)))
    (tmp_path / "bad.npz").write_bytes(b"junk")
    got = {(r.dialogue_id, r.name): (r.shape, r.values) for r in read_npz(spark, str(tmp_path)).collect()}
    assert got == {("d1", "A"): ([2], [1.0, 2.0]), ("d1", "B"): ([2, 3], [0.0] * 6), ("bad", None): (None, None)}


def test_shards(spark):
    df = spark.createDataFrame([("w", 1, 3, [3.0, 0.0]), ("w", 0, 3, [1.0, 2.0])], "param string, rank int, n int, values array<double>")
    assert reassembled(df, 2).first().values == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="don't fit: w"):
        reassembled(df, 3).collect()
    assert sorted(["rank_10", "rank_9", "rank_1"], key=natural_order) == ["rank_1", "rank_9", "rank_10"]


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    line = '[{"speaker":"A","word":"hi","start":0,"end":1}]'
    (src / "a.json").write_text(line)
    count = lambda df: df.groupBy("dialogue_id").agg(F.count("*").alias("n"))
    for extra in ("b.json", "c.json"):
        run_available(transcript_stream(spark, str(src)), count, out, str(tmp_path / "cp"))
        (src / extra).write_text(line)
    assert sorted((r.dialogue_id, r.n) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1)]
