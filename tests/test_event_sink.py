"""The committed sink: whole batches only."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from shipyard.sources import events as EV

SCHEMA = "k long, t string"


def test_batches_are_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = spark.range(100, numPartitions=4).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("a\"\né"), "id")).alias("t"))
    EV.write_committed(df, path, "1")
    assert rows(EV.read_committed(spark, path, SCHEMA)) == rows(df)

    def dies(batches):
        for b in batches:
            yield b
        raise RuntimeError("task dies after its rows")

    late = df.where("k >= 50").mapInArrow(dies, SCHEMA)
    with pytest.raises(Exception, match="task dies"):
        EV.write_committed(late, path, "2")
    assert os.listdir(f"{path}/commits") == ["1.json"] or sorted(os.listdir(f"{path}/commits")) == [".1.json.crc", "1.json"]
    assert rows(EV.read_committed(spark, path, SCHEMA)) == rows(df)
    # a file that no commit names is not read; a batch that is written again replaces itself
    with open(f"{path}/data/orphan.json", "w") as f:
        f.write('{"k":1,"t":"x"}\n')
    EV.write_committed(df.where("k < 10"), path, "1")
    EV.write_committed(df.where("k < 0"), path, "3")
    assert rows(EV.read_committed(spark, path, SCHEMA)) == rows(df.where("k < 10"))


def test_stream_commits_each_batch(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "sink")
    for k in range(2):
        spark.range(k * 10, k * 10 + 10, numPartitions=2).selectExpr("id AS k", "'x' AS t").write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        EV.stream_committed(stream, path, str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination(120)
        assert EV.read_committed(spark, path, SCHEMA).count() == 10 * (k + 1)
    assert sorted(f for f in os.listdir(f"{path}/commits") if f.endswith("json")) == ["0.json", "1.json"]
