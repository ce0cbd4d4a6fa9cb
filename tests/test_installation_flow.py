import copy
import json

from pyspark.sql import functions as F

from conftest import rows
from shipyard.operators import messages as M
from shipyard.plans.installation import run_installation
from test_documents import DOC, RUNNABLE

OUT_SCHEMA = "msg_id string, phase_id string, srv_pos int, visit_pos int, entry_pos int, rec_pos int, exit_status int"


def _docs(spark, bodies):
    msgs = spark.createDataFrame(
        [(m, "c1", "Prod", "plan-1", "install", "INSTALLATION", json.dumps(b)) for m, b in bodies],
        "msg_id string, client_id string, environment string, execution_plan string, command string, "
        "type_message string, body string")
    return M.parse_body(M.route(M.normalize_codes(msgs)), "INSTALLATION")


def test_flow_stops_at_first_failure(spark):
    ok_doc = copy.deepcopy(RUNNABLE)
    ok_doc["executionPlan"] = [ph for ph in ok_doc["executionPlan"] if ph["id"] != "1"]  # no leading AGENT
    docs = _docs(spark, [("m1", ok_doc), ("m2", ok_doc), ("m3", RUNNABLE)])
    # m1: every step passes. m2: the balancer recipe of phase "2" fails.
    ok = [("10", 0, 1, 1, 0), ("10", 1, 0, 0, 0), ("2", 0, 0, 0, 0), ("2", 0, 0, 0, 1), ("2", 0, 0, 2, 0),
          ("2", 0, 2, 0, 0), ("2", 0, 2, 0, 1), ("2", 0, 2, 2, 0)]
    out = [("m1", ph, s, v, e, r, 0) for (ph, s, v, e, r) in ok]
    out += [("m2", ph, s, v, e, r, 1 if (ph, s, v, e, r) == ("2", 0, 0, 0, 1) else 0) for (ph, s, v, e, r) in ok]
    res = run_installation(docs, spark.createDataFrame(out, OUT_SCHEMA), created_at="2024-01-01 00:00:00")

    phases = rows(res.phase_results, "msg_id", "phase_id", "effective_exit")
    # m3 starts with an AGENT phase and no earlier response: the agent fails there and stops
    assert phases == [("m1", "10", 0), ("m1", "2", 0), ("m2", "10", 0), ("m2", "2", 1), ("m3", "1", 1)]
    m2_steps = rows(res.steps.where("msg_id = 'm2'"), "phase_id", "visit_pos", "recipe", "failed_here")
    assert m2_steps[-1] == ("2", 0, "recipe[mv_balancer::create_jk]", True)
    assert len(m2_steps) == 4  # phase 10: two visits; phase 2: r1 then the failing recipe

    st = rows(res.status_events.where("event_kind = 'result'"), "msg_id", "phase_id", "cd_item_status")
    assert set(st) == {("m1", "10", "c"), ("m1", "2", "c"), ("m2", "10", "c"), ("m2", "2", "e"), ("m3", "1", "e")}
    # status rows: one per (phase, first-wins product); 5 products per document
    assert res.status_events.where("msg_id = 'm1'").count() == 2 * 2 * 5

    srv_ev = rows(res.server_events.where("msg_id = 'm2'"), "phase_id", "srv_pos", "cd_item_status")
    assert set(srv_ev) == {("10", 0, "c"), ("10", 1, "c"), ("2", 0, "e")}

    assert rows(res.registry_updates, "cd_produto")[:2] == [("A",), ("B",)]
    assert res.registry_updates.count() == 5  # only m1 completed
    logs = rows(res.logs.where("ds_nivel = 'ERROR'"), "lo_conteudo")
    assert ("h1 | Prod | install | recipe[mv_balancer::create_jk] finalizado no servidor com falha!",) in logs
    done = res.logs.where(F.col("lo_conteudo") == "Processo concluido!").select("cd_cliente").count()
    assert done == 1

    topo = rows(res.topology.where("server_host IS NOT NULL").select("environment", "server_host", "product_name")
                .distinct())
    assert ("prod", "h1", "SOUL-PRODUCT-REPORTS") in topo


def test_flow_rejects_failed_validation(spark):
    docs = _docs(spark, [("m1", RUNNABLE)])
    res = run_installation(docs, spark.createDataFrame([], OUT_SCHEMA),
                           results=spark.createDataFrame([("m1", "CHECK_AGENT_VERSION", False)],
                                                         "msg_id string, rule string, passed boolean"))
    assert res.steps.count() == 0
    assert rows(res.logs, "ds_nivel", "lo_conteudo") == [
        ("ERROR", "Requisitos para procedimentos no ambiente não atendidos, processo abortado!")]


import os  # noqa: E402

import pytest  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables not present")
def test_flow_on_order_documents(spark):
    """Every order of the driver tables as an installation message, through the whole flow."""
    from shipyard.plans import standins as SI

    msgs, outcomes = SI.order_installations(spark, SF_SMALL)
    docs = M.parse_body(M.route(M.normalize_codes(msgs)), "INSTALLATION").select(
        "msg_id", "client_id", "environment", "execution_plan", "command", "doc", "_corrupt")
    none_failed = spark.createDataFrame([], "msg_id string, rule string, passed boolean")
    res = run_installation(docs, outcomes, results=none_failed, created_at="2024-01-01 00:00:00")
    errors = {}
    for r in res.errors.collect():
        errors.setdefault(r.error, set()).add(int(r.msg_id))
    lines = [(r.l_orderkey, r.l_linenumber, r.l_returnflag) for r in spark.read.parquet(f"{SF_SMALL}/orders.parquet").join(
        spark.read.parquet(f"{SF_SMALL}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey")).collect()]
    keys = {k for k, _, _ in lines}
    # no rule has failed, so only broken bodies and missing variants keep a message from running
    assert errors["corrupt body"] == {k for k in keys if k % 11 == 3}
    missing = {k for k, n, _ in lines if k % 17 == 7 and n == 1 and k % 11 != 3}
    assert errors["no product group CLASRISCO_REPORTS"] == missing
    running = {k for k in keys if k % 11 != 3} - missing
    silent = {k for k in running if k % 13 == 5}
    assert errors["no outcome reported"] == silent
    per = {(int(r.msg_id), r.phase_id): r.effective_exit for r in res.phase_results.collect()}
    failing = {k for k, _, flag in lines if flag == "R" and k in running - silent}
    assert {k for k, _ in per} == running - silent
    for k in running - silent:
        assert per[k, "10"] == (1 if k in failing else 0)  # text order: "10" before "2"
        assert ((k, "2") in per) == ((k, "3") in per) == (k not in failing)
        if k not in failing:
            assert per[k, "2"] == per[k, "3"] == 0  # phase 3 carries phase 2's response
    assert {int(r.msg_id) for r in res.registry_updates.collect()} <= running - silent - failing


def test_missing_outcomes_are_no_success(spark):
    ok_doc = copy.deepcopy(RUNNABLE)
    ok_doc["executionPlan"] = [ph for ph in ok_doc["executionPlan"] if ph["id"] != "1"]
    res = run_installation(_docs(spark, [("m1", ok_doc)]), spark.createDataFrame([], OUT_SCHEMA),
                           created_at="2024-01-01 00:00:00")
    assert rows(res.errors) == [("m1", "no outcome reported")]
    assert rows(res.steps, "phase_id", "srv_pos", "exit_status", "_error") == [("10", 0, None, "no outcome reported")]
    assert res.phase_results.count() == res.status_events.count() == res.registry_updates.count() == 0
    assert res.server_events.count() == 0
    texts = [t for _, t in rows(res.logs, "ds_nivel", "lo_conteudo")]
    assert not any("sucesso" in t or "concluido" in t for t in texts)
    assert rows(res.logs.where("ds_nivel = 'ERROR'"), "lo_conteudo") == [("no outcome reported",)]


def test_errors_keep_a_message_from_running(spark):
    bad = copy.deepcopy(RUNNABLE)
    bad["validations"] = [{"name": "CHECK_MOON", "metric": "full"}]
    old = copy.deepcopy(RUNNABLE)
    old["validations"] = [{"name": "CHECK_AGENT_VERSION", "metric": "v2"}]
    docs = _docs(spark, [("group", DOC), ("rule", bad), ("version", old)])
    from shipyard.operators.rules import Observations

    agents = spark.createDataFrame([("c1", "v1")], "client_id string, agent_version string")
    res = run_installation(docs, spark.createDataFrame([], OUT_SCHEMA), observations=Observations(agents=agents),
                           created_at="2024-01-01 00:00:00")
    assert rows(res.errors) == [("group", "no product group CLASRISCO_REPORTS"), ("rule", "unknown validation rule")]
    assert res.steps.count() == 0 and res.topology.count() == 0
    assert len([t for _, t in rows(res.logs, "ds_nivel", "lo_conteudo") if t.startswith("Requisitos")]) == 1


def test_snapshot_stays_with_its_client(spark):
    """Two clients with an environment of one name: only the snapshot's own client gets its servers."""
    docs = _docs(spark, [("m1", RUNNABLE)])
    docs = docs.unionByName(docs.withColumn("msg_id", F.lit("m2")).withColumn("client_id", F.lit("c2")))
    first = run_installation(docs, spark.createDataFrame([], OUT_SCHEMA), created_at="2024-01-01 00:00:00").topology
    snap = first.where("msg_id = 'm1' AND server_host = 'h1'").limit(1).withColumn("server_host", F.lit("gone"))
    res = run_installation(docs, spark.createDataFrame([], OUT_SCHEMA), snapshot=snap, created_at="2024-01-01 00:00:00")
    got = rows(res.topology.where("server_host = 'gone'"), "client_id", "environment", "msg_id")
    assert got == [("c1", "prod", "m1")]


def test_no_password_reaches_a_file(spark, tmp_path):
    """Broken bodies, escaped quotes and every secret field, through the fan-out."""
    import glob

    from shipyard.streaming.messages import route_writer

    broken = json.dumps(RUNNABLE)[:-40].replace('"secret"', '"ab\\\\\\"hunter2"')
    database = json.dumps({"cdUserApp": "u", "passwordApp": "hunter3", "passwordInstall": "hunter4"})
    boot = json.dumps({"name": "n", "passwordUser": "hunter5"})
    free = json.dumps({"version": "1", "serverPassword": "hunter6"})
    msgs = spark.createDataFrame(
        [("m1", "installation", broken), ("m2", "installation", json.dumps(RUNNABLE)), ("m3", "check_database", database),
         ("m4", "bootstrap", boot), ("m5", "update_agent", free), ("m6", "else", "hunter7"), ("m7", "update_agent", "hunter8")],
        "msg_id string, type_message string, body string")
    out = str(tmp_path / "out")
    route_writer(out)(M.route(M.normalize_codes(msgs, command_col=None)), 0)
    got = spark.read.parquet(out)
    assert got.count() == 7 and "body" not in got.columns
    text = " ".join(str(tuple(r)) for r in got.collect())
    assert "hunter" not in text and "secret" not in text and "md5 " in text
    for f in glob.glob(f"{out}/**/*.parquet", recursive=True):
        raw = open(f, "rb").read()
        assert b"hunter" not in raw and b"secret" not in raw


def test_no_output_writes_or_shuffles_whole_documents(spark, monkeypatch):
    """Messages that do not run are told by their ids: no table of the flow holds documents, and no message of theirs gives a row."""
    from shipyard.operators import tables
    from shipyard.plans import installation

    written = []
    monkeypatch.setattr(installation, "materialize_table", lambda df: written.append(df.columns) or tables.materialize_table(df))
    failing = copy.deepcopy(RUNNABLE)
    failing["validations"] = [{"name": "CHECK_AGENT_VERSION", "metric": "v9"}]
    ran = copy.deepcopy(RUNNABLE)
    ran["executionPlan"] = [ph for ph in ran["executionPlan"] if ph["id"] != "1"]
    msgs = _docs(spark, [("m1", ran), ("m2", failing), ("m3", RUNNABLE)]).withColumn("arrival_ts", F.lit("2024-01-01").cast("timestamp"))
    ok = [("10", 0, 1, 1, 0), ("10", 1, 0, 0, 0), ("2", 0, 0, 0, 0), ("2", 0, 0, 0, 1), ("2", 0, 0, 2, 0),
          ("2", 0, 2, 0, 0), ("2", 0, 2, 0, 1), ("2", 0, 2, 2, 0)]
    out = [(m, *k, 0) for m in ("m1", "m2", "m3") for k in ok]
    res = run_installation(msgs, spark.createDataFrame(out, OUT_SCHEMA), created_at="2024-01-01 00:00:00", order=("arrival_ts", "msg_id"))
    held = {name: {r.msg_id for r in getattr(res, name).select("msg_id").collect()}
            for name in ("phases", "steps", "status_events", "server_events", "registry_updates", "topology", "balancers")}
    assert held == {"phases": {"m1", "m3"}, "steps": {"m1", "m3"}, "status_events": {"m1", "m3"}, "server_events": {"m1"},
                    "registry_updates": {"m1"}, "topology": {"m1", "m3"}, "balancers": {"m1", "m3"}}
    assert written and not [c for c in written if "doc" in c]
