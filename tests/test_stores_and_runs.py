"""Stored registry, snapshot commits, run durations and the bounded history."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from conftest import rows
from shipyard.operators import messages as M
from shipyard.operators import outcomes as O
from shipyard.sources import files, registry


def part_files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith(registry.PART)}


def test_registry_store_replaces_touched_partitions_only(spark, tmp_path):
    path, key = str(tmp_path / "reg"), ["client_id", "cd"]
    base = spark.range(200).select((F.col("id") % 10).cast("string").alias("client_id"), F.concat(F.lit("p"), "id").alias("cd"), F.lit("1").alias("version"))
    registry.create_registry(base, path, key, partitions=16)
    before = part_files(path)
    have = spark.createDataFrame([(str(c), c != 3) for c in range(10)], "client_id string, registry_exists boolean")
    upd = spark.createDataFrame([("1", "p1", "2", 0), ("1", "p1", "3", 1), ("3", "p3", "9", 0), ("7", "new", "1", 0)],
                                "client_id string, cd string, version string, at int")
    touched = registry.update_registry(spark, upd, path, key, ["at"], partitions=16, registries=have)
    after = part_files(path)
    assert 1 <= len(touched) <= 2
    assert {d for d in before if before[d] != after[d]} == {f"{registry.PART}={t}" for t in touched}
    want = {(str(k % 10), f"p{k}"): "1" for k in range(200)} | {("1", "p1"): "3", ("7", "new"): "1"}
    assert {(r.client_id, r.cd): r.version for r in registry.read_registry(spark, path).collect()} == want
    assert registry.update_registry(spark, upd.where("client_id = '3'"), path, key, ["at"], partitions=16, registries=have) == []
    again = registry.update_registry(spark, upd, path, key, ["at"], partitions=16, registries=have)  # a retry changes nothing
    assert again == touched and {(r.client_id, r.cd): r.version for r in registry.read_registry(spark, path).collect()} == want


def test_half_written_generation_is_never_read(spark, tmp_path):
    path = str(tmp_path / "snap")
    a = spark.createDataFrame([("c1", "prod", 1), ("c2", "prod", 1)], "client_id string, environment string, v int")
    files.write_generation(a, path, 1)
    assert files.load_snapshot(spark, path) is None  # no commit yet
    files.save_snapshot(a, path, 1)
    files.write_generation(a.withColumn("v", F.lit(2)), path, 2)
    assert rows(files.load_snapshot(spark, path), "client_id", "v") == [("c1", 1), ("c2", 1)]
    files.save_snapshot(a.where("client_id = 'c1'").withColumn("v", F.lit(3)), path, 3)
    assert rows(files.load_snapshot(spark, path), "client_id", "v") == [("c1", 3), ("c2", 1)]
    assert rows(files.load_snapshot(spark, path, before=3), "client_id", "v") == [("c1", 1), ("c2", 1)]


def test_run_durations(spark):
    at = dt.datetime(2024, 1, 1)

    def t(**k):
        return at + dt.timedelta(**k)

    ev = [("m", "start", t()), ("m", "end", t(days=2, hours=3, minutes=4, seconds=5)), ("m", "end", t(days=3)), ("m", "start", t(days=4)),
          ("m", "start", t(days=5)), ("m", "end", t(days=5, seconds=61)), ("m", "other", t(days=6)), ("n", "end", t()), ("n", "start", t()), ("o", "end", t(days=1))]
    got = rows(O.run_durations(spark.createDataFrame(ev, "msg_id string, kind string, ts timestamp_ntz")), "msg_id", "start_ts", "end_ts", "hours", "minutes", "seconds")
    assert got == sorted([
        ("m", t(), t(days=2, hours=3, minutes=4, seconds=5), 3, 4, 5), ("m", None, t(days=3), None, None, None), ("m", t(days=4), None, None, None, None),
        ("m", t(days=5), t(days=5, seconds=61), 0, 1, 1), ("n", t(), t(), 0, 0, 0), ("o", None, t(days=1), None, None, None)], key=lambda r: tuple(map(str, r)))


def test_bounded_history_equals_loop(spark):
    rng = random.Random(8)
    msgs = [(k, rng.choice(["hot"] * 4 + ["c2", "c3", None]), rng.randrange(12), rng.choice("xy"), k // 3) for k in range(900)]
    df = spark.createDataFrame(msgs, "msg_id int, client_id string, message_id int, type_message string, arrival_ts int").repartition(5)
    got = [r.msg_id for r in M.dedup_history(df, limit=10, keep=2).collect()]
    want, history = [], {}
    for m in sorted(msgs, key=lambda m: (m[4], m[0])):
        if m[1] is None:
            continue
        past = history.setdefault(m[1], [])
        if (m[2], m[3]) not in past:
            want.append(m[0])
            past.append((m[2], m[3]))
            if len(past) == 10:
                history[m[1]] = past[-2:]
    assert sorted(got) == sorted(want) and len(want) < len(msgs)
