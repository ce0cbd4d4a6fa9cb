import copy
import json

from pyspark.sql import functions as F

from conftest import rows
from shipyard import schemas as S
from shipyard.operators import documents as D
from shipyard.operators import messages as M
from shipyard.operators import outcomes as O


def app(name, version="1", typ="web", port="8080", bh="lb1", bp="80", context=None, server_id="s"):
    return {"productname": name, "group": "g", "context": context, "type": typ, "version": version,
            "itemVersion": f"{name}-{version}", "port": port, "serverId": server_id, "balancer_host": bh,
            "balancer_port": bp, "serverInstance": "i"}


DOC = {
    "list_server": [
        {"soulmvlinux": {"serverHost": "h1", "serverUser": "u", "serverPassword": "secret", "serverType": "linux",
                         "environment": "prod", "urlbase": "x"},
         "tomcatinstance": {"port": ["8080", "9090"]},
         "app_list": [app("SOULMV-H5", typ="reports"), app("A", "1"), app("B", "1")],
         "run_list": [{"id": "2", "recipes": ["r1", "recipe[mv_balancer::create_jk]"]},
                      {"id": "10", "recipes": ["r3"]}, {"id": "2", "recipes": ["r4"]}]},
        {"soulmvlinux": {"serverHost": "h2", "serverUser": "u", "serverPassword": "secret2", "serverType": "Windows",
                         "environment": "prod", "urlbase": "y"},
         "tomcatinstance": {"port": ["8080"]},
         "app_list": [app("A", "2"), app("CLASRISCO", typ="reports"), app("SOULMV-WI5")],
         "run_list": [{"id": "10", "recipes": ["r5"]}]},
    ],
    "listBalancer": [{"host": "lb1", "port": "80"}],
    "executionPlan": [
        {"id": "2", "type": "chef", "statusInitial": "s", "statusComplete": "c", "statusError": "e"},
        {"id": "10", "type": "CHEF", "statusInitial": "s", "statusComplete": "c", "statusError": "e"},
        {"id": "1", "type": "agent", "statusInitial": "s", "statusComplete": "c", "statusError": "e"},
        {"id": "7", "type": "chef", "statusInitial": "s", "statusComplete": "c", "statusError": "e"},
    ],
    "validations": [],
}

# The same without the app that names a group variant which does not exist.
RUNNABLE = copy.deepcopy(DOC)
RUNNABLE["list_server"][1]["app_list"][1]["type"] = "web"


def docs(spark):
    msgs = spark.createDataFrame([("m1", "INSTALLATION", json.dumps(DOC)), ("m2", "INSTALLATION", "{bad json")],
                                 "msg_id string, type_message string, body string")
    return M.parse_body(M.route(msgs), "INSTALLATION")


def test_parse_body_masks_passwords_and_quarantines(spark):
    d = docs(spark)
    assert "serverPassword" not in d.schema["doc"].dataType["list_server"].dataType.elementType[
        "soulmvlinux"].dataType.fieldNames()
    got = rows(d.select("msg_id", F.col("_corrupt").isNotNull().alias("bad")))
    assert got == [("m1", False), ("m2", True)]


def test_servers_apps_and_first_products(spark):
    srv = D.servers(docs(spark).where("msg_id = 'm1'"))
    assert rows(srv, "srv_pos", "server_host", "server_type") == [(0, "h1", "LINUX"), (1, "h2", "WINDOWS")]
    first = D.first_products(D.apps(srv))
    # first-wins by name in server then app order; groups stay unexpanded (W1 runs before J1)
    assert rows(first, "productname", "version", "srv_pos") == [
        ("A", "1", 0), ("B", "1", 0), ("CLASRISCO", "1", 1), ("SOULMV-H5", "1", 0), ("SOULMV-WI5", "1", 1)]


def test_expand_groups_with_reference_groups(spark):
    srv = D.servers(docs(spark).where("msg_id = 'm1'"))
    groups, contexts = D.dimension_tables()
    out = D.expand_groups(D.apps(srv), groups, contexts)
    got = rows(out, "srv_pos", "app_pos", "item_pos", "productname", "type", "context", "_error")
    assert got == [
        (0, 0, 0, "SOUL-PRODUCT-REPORTS", "forms", "soul-product-reports", None),  # reports variant of H5
        (0, 1, None, "A", "web", None, None),
        (0, 2, None, "B", "web", None, None),
        (1, 0, None, "A", "web", None, None),
        (1, 1, None, "CLASRISCO", "reports", None, "no product group CLASRISCO_REPORTS"),
        (1, 2, 0, "SOUL-INTEGRATED-WORKSPACE", "forms", "soul-mv", None),
        (1, 2, 1, "SOUL-INTEGRATED-SERVICES", "forms", "soul-integrated-services", None),
    ]


def test_plan_phases_counts_each_matching_entry(spark):
    d = docs(spark).where("msg_id = 'm1'")
    ph = D.phases(d)
    entries = D.run_entries(D.servers(d))
    plan = D.plan_phases(ph, entries)
    # "2": h1 has two entries with id 2 -> visited twice; "10": h1 and h2; "1": AGENT kept with none;
    # "7": CHEF without servers dropped
    assert rows(plan, "id", "type", "n_servers") == [("1", "AGENT", 0), ("10", "CHEF", 2), ("2", "CHEF", 2)]


def test_steps_then_fail_stop_sorts_phase_ids_as_text(spark):
    d = docs(spark).where("msg_id = 'm1'")
    ph = D.phases(d).withColumnRenamed("id", "phase_id")
    entries = D.run_entries(D.servers(d))
    visits = D.phase_visits(ph.withColumnRenamed("phase_id", "id"), entries).select(
        "msg_id", F.col("id").alias("phase_id"), "plan_pos", "srv_pos",
        F.col("entry_pos").alias("visit_pos"))
    st = D.steps(visits, entries.drop("server_host", "server_type"))
    # phase "10" sorts before "2"; in "2", h1 is visited twice and each visit runs both entries
    exits = {"r3": 0, "r5": 0, "r1": 0, "recipe[mv_balancer::create_jk]": 1, "r4": 0}
    st = st.withColumn("exit_status", F.create_map(*[F.lit(x) for kv in exits.items() for x in kv])[F.col("recipe")])
    kept = O.fail_stop(st, order=("phase_id", "plan_pos", "srv_pos", "visit_pos", "entry_pos", "rec_pos"))
    got = rows(kept, "phase_id", "srv_pos", "recipe", "failed_here")
    assert got == [("10", 0, "r3", False), ("10", 1, "r5", False),
                   ("2", 0, "r1", False), ("2", 0, "recipe[mv_balancer::create_jk]", True)]
    assert rows(st.where("is_balancer"), "recipe")[0] == ("recipe[mv_balancer::create_jk]",)


def test_status_events_and_server_events(spark):
    ph = spark.createDataFrame(
        [("m", "1", "s", "c", "e", "0", "100", "start", "end", 0, "cl", "plan"),
         ("m", "2", "s", "c", "e", "0", "100", "start2", "end2", 3, "cl", "plan")],
        "msg_id string, phase_id string, statusInitial string, statusComplete string, statusError string, "
        "initialProgress string, finalProgress string, initialDescription string, finalDescription string, "
        "exit_status int, client_id string, execution_plan string")
    prod = spark.createDataFrame([("m", "A", "A-1", "prod")], "msg_id string, name string, itemVersion string, "
                                                              "environment string")
    ev = D.status_events(ph, prod, created_at="2024-01-01 00:00:00")
    assert rows(ev, "phase_id", "event_kind", "cd_item_status", "ds_progresso") == [
        ("1", "result", "c", "end"), ("1", "start", "s", "start"),
        ("2", "result", "e", "Erro - start2"), ("2", "start", "s", "start2")]


def test_script_index_last_package_wins(spark):
    sc = spark.createDataFrame([("m", "a.sql", "p1", 1), ("m", "a.sql", "p2", 2), ("m", "b.sql", "p1", 1)],
                               "msg_id string, name string, package string, pos int")
    assert rows(D.script_index(sc), "name", "package") == [("a.sql", "p2"), ("b.sql", "p1")]


def test_group_dimension_is_the_fixed_list():
    g, _ = D.dimension_tables()
    assert g["SOULMV_H5_REPORTS"] == ["SOUL-PRODUCT-REPORTS"] and len(g) == 7
