import datetime as dt
import copy
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import ROOT, rows
from shipyard import schemas as S
from shipyard.operators import messages as M
from shipyard.streaming import messages as SM

SF = "/root/testdata/sf0.01"


def _write_batches(folder, batches):
    os.makedirs(folder, exist_ok=True)
    for i, batch in enumerate(batches):
        path = os.path.join(folder, f"part-{i:03d}.json")
        with open(path, "w") as fh:
            for m in batch:
                fh.write(json.dumps(m) + "\n")
        # the file source takes files in modification-time order
        os.utime(path, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))


def _msg(i, client, mid, typ, checksum, minute):
    return {"client_id": client, "environment": "prod", "execution_plan": "p", "message_id": mid,
            "checksum": checksum, "type_message": typ, "command": "install", "body": "{}",
            "arrival_ts": (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)).isoformat()}


def test_stream_equals_batch(spark, tmp_path):
    batches = [
        [_msg(1, "c1", "m1", "installation", "h1", 0), _msg(2, "c1", "m2", "bootstrap", "bad", 1),
         _msg(3, "c2", "m3", "check_database", None, 2)],
        [_msg(4, "c1", "m1", "installation", "h1", 3),          # repeat of m1: dropped
         _msg(5, "c3", "m5", "update_agent", None, 4),          # unknown client
         _msg(6, None, "m6", "update_agent", None, 5)],         # no client id
        [_msg(7, "c2", "m7", "nonsense", None, 6), _msg(8, "c1", "m1", "bootstrap", "h1", 7)],
    ]
    src = str(tmp_path / "in")
    _write_batches(src, batches)
    clients = spark.createDataFrame([("c1", "h1", "1"), ("c2", None, "1")], S.CLIENT_SCHEMA)

    routed = SM.message_stream(spark, src, clients, watermark="1 day", max_files_per_trigger=1)
    out = str(tmp_path / "out")
    q = SM.start_fan_out(routed, out, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    streamed = spark.read.parquet(out)

    batch_msgs = spark.read.schema(S.MESSAGE_SCHEMA).json(src).where(F.col("client_id").isNotNull())
    batch = M.route(M.dedup_messages(M.accept_messages(M.normalize_codes(batch_msgs), clients)))
    cols = ("client_id", "message_id", "type_message", "route")
    assert rows(streamed, *cols) == rows(batch, *cols)
    assert rows(streamed, *cols) == [
        ("c1", "m1", "BOOTSTRAP", "BOOTSTRAP"), ("c1", "m1", "INSTALLATION", "INSTALLATION"),
        ("c2", "m3", "CHECK_DATABASE", "CHECK_DATABASE"), ("c2", "m7", "UNKNOWN", "UNKNOWN")]
    # one folder per micro-batch: a retried batch overwrites only itself
    assert streamed.select("batch_id").distinct().count() >= 2


def test_driver_contract_keys_match():
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 29


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["route", "n_messages"]
    assert df.count() > 0


ORACLE_FAST = ["msg_route", "products_first", "group_expand", "fail_stop", "phase_outcome", "grant_gap",
               "not_in", "fk_gap", "privileges", "statements", "topology", "registry", "disk"]


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", ORACLE_FAST)
def test_query_matches_oracle(spark, name):
    import sys

    sys.path.insert(0, os.path.join(ROOT, "tests"))
    from oracle_compare import compare

    assert compare(spark, SF, [name], verbose=False)[name] is True


def test_stream_dedup_is_bounded_by_event_time(spark, tmp_path):
    """A repeat within the watermark is dropped; once the watermark has passed the
    first copy, its state expires at the end of that micro-batch and a later repeat
    runs again. The bound is event time, not a count of messages."""
    batches = [
        [_msg(1, "c1", "m1", "check_database", None, 0)],
        [_msg(2, "c1", "m1", "check_database", None, 5),      # within 10 minutes: dropped
         _msg(3, "c1", "m9", "check_database", None, 60)],    # moves the watermark to 50 minutes
        [_msg(4, "c1", "m8", "check_database", None, 61)],    # this batch ends by expiring m1's state
        [_msg(5, "c1", "m1", "check_database", None, 55)],    # first copy expired: runs again
    ]
    src = str(tmp_path / "in")
    _write_batches(src, batches)
    clients = spark.createDataFrame([("c1", "h1", "1")], S.CLIENT_SCHEMA)
    routed = SM.message_stream(spark, src, clients, watermark="10 minutes", max_files_per_trigger=1)
    out = str(tmp_path / "out")
    SM.start_fan_out(routed, out, str(tmp_path / "ckpt")).awaitTermination(120)
    got = rows(spark.read.parquet(out), "message_id", "arrival_ts")
    assert [m for m, _ in got] == ["m1", "m1", "m8", "m9"]
    assert sorted(ts.minute for m, ts in got if m == "m1") == [0, 55]


def test_installation_flow_inside_foreach_batch(spark, tmp_path):
    """The batch-only flow runs per micro-batch and gives the rows of one batch run."""
    from shipyard.plans.installation import run_installation
    from test_documents import RUNNABLE

    doc = dict(RUNNABLE, executionPlan=[ph for ph in RUNNABLE["executionPlan"] if ph["id"] != "1"])

    def inst(mid, minute):
        m = _msg(0, "c1", mid, "installation", "h1", minute)
        m["body"] = json.dumps(doc)
        return m

    src = str(tmp_path / "in")
    _write_batches(src, [[inst("m1", 0)], [inst("m2", 1)]])
    clients = spark.createDataFrame([("c1", "h1", "1")], S.CLIENT_SCHEMA)
    outcomes = spark.createDataFrame(
        [(m, "10", 0, 1, 1, 0, 0) for m in ("m1", "m2")] + [(m, "10", 1, 0, 0, 0, 0) for m in ("m1", "m2")],
        S.STEP_OUTCOME_SCHEMA)
    routed = SM.message_stream(spark, src, clients, watermark="1 day", max_files_per_trigger=1) \
        .withColumn("msg_id", F.col("message_id"))
    out = str(tmp_path / "out")
    q = routed.writeStream.foreachBatch(SM.installation_writer(outcomes, out, created_at="2024-01-01 00:00:00")) \
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    streamed = spark.read.parquet(f"{out}/status_events").drop("batch_id")

    batch_msgs = spark.read.schema(S.MESSAGE_SCHEMA).json(src).withColumn("msg_id", F.col("message_id"))
    docs = M.parse_body(M.route(M.normalize_codes(batch_msgs)), "INSTALLATION").select(
        "msg_id", "client_id", "environment", "execution_plan", "command", "doc")
    batch = run_installation(docs, outcomes, created_at="2024-01-01 00:00:00").status_events
    assert rows(streamed) == rows(batch.select(*streamed.columns))
    assert streamed.count() > 0
    errors = rows(spark.read.parquet(f"{out}/errors"), "msg_id", "error")
    assert errors == [("m1", "no outcome reported"), ("m2", "no outcome reported")]  # phase "2" has none


def test_streamed_installations_are_judged(spark, tmp_path):
    """A2 + A5 + J4 inside foreachBatch: a failing, an unknown, an unobserved and passing messages;
    the second batch finds the topology that the first has left."""
    from shipyard.operators.catalog import registry_exists
    from shipyard.operators.rules import Observations
    from shipyard.sources.files import load_snapshot
    from test_documents import RUNNABLE

    def inst(mid, minute, rules, server=None, environment="Prod"):
        doc = copy.deepcopy(RUNNABLE)
        doc["executionPlan"] = [ph for ph in doc["executionPlan"] if ph["id"] == "10"]
        doc["validations"] = rules
        if server:
            doc["list_server"][0]["soulmvlinux"]["serverHost"] = server
        m = _msg(0, "c1", mid, "installation", "h1", minute)
        return m | {"body": json.dumps(doc), "command": "install", "environment": environment}

    v1 = [{"name": "CHECK_AGENT_VERSION", "metric": "v1"}]
    batches = [[inst("pass1", 0, v1), inst("old", 1, [{"name": "CHECK_AGENT_VERSION", "metric": "v9"}]),
                inst("moon", 2, [{"name": "CHECK_MOON", "metric": "full"}]),
                inst("disk", 3, [{"name": "CHECK_SERVERS_DISK_SPACE", "metric": "1"}]), inst("bare", 4, v1, environment="Test")],
               [inst("pass2", 10, v1, server="h9")]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write_batches(src, batches)
    clients = spark.createDataFrame([("c1", "h1", "1")], S.CLIENT_SCHEMA)
    everyone = ("pass1", "old", "moon", "disk", "bare", "pass2")
    outcomes = spark.createDataFrame([(m, "10", 0, 1, 1, 0, 0) for m in everyone] + [(m, "10", 1, 0, 0, 0, 0) for m in everyone],
                                     S.STEP_OUTCOME_SCHEMA)
    agents = spark.createDataFrame([("c1", "v1")], "client_id string, agent_version string")
    envs = spark.createDataFrame([("c1", "Prod"), ("c1", "Test")], "client_id string, environment string")
    objects = spark.createDataFrame([("c1", "Prod", S.REGISTRY_OBJECT, S.REGISTRY_OWNER)],
                                    "client_id string, environment string, object_name string, owner string")
    routed = SM.message_stream(spark, src, clients, watermark="1 day", max_files_per_trigger=1).withColumn("msg_id", F.col("message_id"))
    writer = SM.installation_writer(outcomes, out, created_at="2024-01-01 00:00:00", observations=Observations(agents=agents),
                                    registries=registry_exists(envs, objects, ["client_id", "environment"]),
                                    snapshot_dir=str(tmp_path / "snapshots"))
    routed.writeStream.foreachBatch(writer).option("checkpointLocation", str(tmp_path / "ckpt")) \
        .trigger(availableNow=True).start().awaitTermination(600)

    read = {name: spark.read.parquet(f"{out}/{name}") for name in SM.INSTALLATION_OUTPUTS}
    assert rows(read["errors"], "msg_id", "error") == [("moon", "unknown validation rule")]
    texts = [r.lo_conteudo for r in read["logs"].collect()]
    assert texts.count(S.LOG_REJECTED) == 2 and texts.count(S.LOG_DONE) == 3
    ran = {r.msg_id for r in read["status_events"].select("msg_id").distinct().collect()}
    assert ran == {"pass1", "bare", "pass2"}
    # the environment without the registry table gets no rows
    assert {r.msg_id for r in read["registry_updates"].collect()} == {"pass1", "pass2"}
    topo = read["topology"]
    assert {r.msg_id for r in topo.collect()} == {"pass1", "bare", "pass2"}
    mine = rows(topo.where("msg_id = 'pass2' AND server_host IN ('h1', 'h9')").select("server_host", "origin").distinct())
    assert mine == [("h1", "old"), ("h9", "new")]
    snap = load_snapshot(spark, str(tmp_path / "snapshots"))
    assert {(r.environment, r.generation) for r in snap.collect()} == {("prod", 2), ("test", 1)}
    assert {"h1", "h9"} <= {r.server_host for r in snap.where("environment = 'prod'").collect()}


def test_late_messages_are_found(spark, tmp_path):
    """What comes behind the watermark is dropped by the stream and returned as error rows."""
    def msg(seq, mid, minute):
        return _msg(seq, "c1", mid, "check_database", None, minute)

    # the late filter follows the watermark by one micro-batch
    batches = [[msg(1, "m1", 0)], [msg(2, "m2", 59)], [msg(3, "m5", 59)], [msg(4, "m3", 1), msg(5, "m1", 2)],
               [msg(6, "m4", 59)]]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write_batches(src, batches)
    clients = spark.createDataFrame([("c1", "h1", "1")], S.CLIENT_SCHEMA)
    routed = SM.message_stream(spark, src, clients, watermark="10 minutes", max_files_per_trigger=1)
    SM.start_fan_out(routed, out, str(tmp_path / "ckpt")).awaitTermination(120)
    written = spark.read.parquet(out)
    assert [m for m, in rows(written, "message_id")] == ["m1", "m2", "m4", "m5"]
    late = SM.late_messages(spark.read.schema(S.MESSAGE_SCHEMA).json(src), written, clients)
    assert rows(late, "message_id", "_error") == [("m3", "later than the watermark")]
