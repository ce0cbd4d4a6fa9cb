"""Messages gated as of their time: batch against a loop, stream against the batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shipyard import schemas as S
from shipyard.operators import messages as M
from shipyard.streaming import gate as G

START = dt.datetime(2024, 1, 1)
MSG = "msg_id string, client_id string, message_id string, type_message string, checksum string, arrival_ts timestamp"
CHANGE = "client_id string, changed_ts timestamp, env_hash string, change_id int"


def random_input(seed, n, hot=False):
    rng = random.Random(seed)
    who = ["c1", "c1", "c1", "c2", "c3", None] if not hot else ["c1"] * 9 + ["c2"]
    msgs = [(f"m{k:04d}", rng.choice(who), rng.choice("abcdef"), rng.choice(["INSTALLATION", "BOOTSTRAP", "CHECK_DATABASE", None]),
             rng.choice(["h1", "h2", None]), START + dt.timedelta(minutes=rng.randrange(600))) for k in range(n)]
    changes = [(rng.choice(["c1", "c2", None]), START + dt.timedelta(minutes=rng.randrange(20, 600)), rng.choice(["h1", "h2", None]), k)
               for k in range(n // 6)]
    return msgs, changes


def held_hash(changes, client, ts):
    """(known, hash) of a client at a time."""
    past = sorted((c[1], c[3], c[2]) for c in changes if c[0] == client and c[1] <= ts) if client else []
    return (True, past[-1][2]) if past else (False, None)


@pytest.mark.parametrize("hot", [False, True])
def test_asof_gate_equals_loop(spark, hot):
    msgs, changes = random_input(3, 500, hot)
    got = M.accept_messages_asof(spark.createDataFrame(msgs, MSG), spark.createDataFrame(changes, CHANGE), change_order=["change_id"])
    want = []
    for m in msgs:
        known, held = held_hash(changes, m[1], m[5])
        if known and (m[3] not in S.CHECKSUM_TYPES or m[4] == held):
            want.append(m[0])
    assert sorted(r.msg_id for r in got.collect()) == sorted(want)
    assert got.columns == [c.split()[0] for c in MSG.split(", ")]


def test_gated_stream(spark, tmp_path):
    """Batches in arrival order; a change between messages, repeats within and after the keep, a late row."""
    def at(minute):
        return START + dt.timedelta(minutes=minute)

    msgs = [
        [("m1", "c1", "a", "INSTALLATION", "h1", at(10)), ("m2", "c1", "b", "INSTALLATION", "h2", at(11)), ("m3", "c9", "c", "CHECK_DATABASE", None, at(12)),
         ("m4", "c1", "a", "INSTALLATION", "h1", at(13))],
        [("m5", "c1", "b", "INSTALLATION", "h2", at(25)), ("m6", "c1", "d", "INSTALLATION", "h1", at(26)), ("m7", "c1", "a", "INSTALLATION", "h2", at(50))],
        [("m8", "c1", "e", "CHECK_DATABASE", None, at(14)), ("m9", "c1", "f", "CHECK_DATABASE", None, at(70))],
        [("end", "c8", "z", "CHECK_DATABASE", None, at(300))],
    ]
    # the change to h2 at minute 20 arrives with the last but one batch of its watermark
    changes = [[("c1", at(0), "h1", 0)], [("c1", at(20), "h2", 1)], [], []]
    src, reg, ckpt, out = (str(tmp_path / x) for x in ("msgs", "changes", "ckpt", "out"))
    for m, c in zip(msgs, changes):
        spark.createDataFrame(m, MSG).write.mode("append").parquet(src)
        spark.createDataFrame(c, CHANGE).write.mode("append").parquet(reg)
        stream = G.gated_stream(spark.readStream.schema(MSG).parquet(src), spark.readStream.schema(CHANGE).parquet(reg),
                                watermark="5 minutes", keep_seconds=1800, salts=3)
        with G.rocksdb_state(spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt) \
                .trigger(availableNow=True).start().awaitTermination(300)
    got = {r.msg_id: r.status for r in spark.read.parquet(out).select("status", F.get_json_object("payload", "$.msg_id").alias("msg_id")).collect()}
    assert got == {"m1": "accepted", "m2": "rejected", "m3": "unknown", "m4": "repeat", "m5": "accepted", "m6": "rejected",
                   "m7": "accepted", "m8": "late", "m9": "accepted"}


def test_clients_share_the_state_of_a_few_keys(spark, tmp_path):
    """Many clients in few keys get what a loop over each client's rows gives, and the state holds blocks, not a row per message."""
    rng = random.Random(5)
    who = [f"c{k}" for k in range(80)]
    msgs = [(f"m{k:04d}", rng.choice([*who, None]), rng.choice("ab"), rng.choice(["INSTALLATION", "CHECK_DATABASE"]),
             rng.choice(["h1", "h2", None]), START + dt.timedelta(minutes=rng.randrange(600))) for k in range(1500)]
    changes = [(rng.choice([*who, None]), START + dt.timedelta(minutes=rng.randrange(300)), rng.choice(["h1", "h2", None]), k) for k in range(120)]
    end = [("end", "c-", "z", "CHECK_DATABASE", None, START + dt.timedelta(days=30))]
    src, reg, ckpt, out = (str(tmp_path / x) for x in ("msgs", "changes", "ckpt", "out"))
    held = []
    for m, c in ((msgs, changes), (end, [])):
        spark.createDataFrame(m, MSG).write.mode("append").parquet(src)
        spark.createDataFrame(c, CHANGE).write.mode("append").parquet(reg)
        stream = G.gated_stream(spark.readStream.schema(MSG).parquet(src), spark.readStream.schema(CHANGE).parquet(reg),
                                watermark="10 days", keep_seconds=7200, salts=2, change_tie_col="change_id", buckets=3)
        with G.rocksdb_state(spark):
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
            q.awaitTermination(300)
        held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    got = {r.msg_id: r.status for r in spark.read.parquet(out).select("status", F.get_json_object("payload", "$.msg_id").alias("msg_id")).collect()}
    assert got.pop("end", None) in (None, "unknown")
    want, first = {}, {}
    for mid, client, message, kind, checksum, ts in sorted((m for m in msgs if m[1]), key=lambda m: (m[5], m[0])):
        known = sorted((c[1], str(c[3]), c[2]) for c in changes if c[0] == client and c[1] <= ts)
        copy = (client, message, kind)
        if not known:
            want[mid] = "unknown"
        elif kind in S.CHECKSUM_TYPES and checksum != known[-1][2]:
            want[mid] = "rejected"
        elif copy in first and ts < first[copy] + dt.timedelta(seconds=7200):
            want[mid] = "repeat"
        else:
            first[copy], want[mid] = ts, "accepted"
    assert got == want and set(want.values()) == {"accepted", "repeat", "rejected", "unknown"}
    assert 0 < max(held) < 100
