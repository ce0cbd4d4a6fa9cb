"""Registered queries: each runs library operators over the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the oracle SQL in ``plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import holds_text
from ..operators import catalog as C
from ..operators import documents as D
from ..operators import messages as M
from ..operators import outcomes as O
from ..operators import rules as R
from ..operators import scripts as X
from ..operators import topology as TP
from ..operators.tables import materialize_table
from ..session import checkpoint_dir
from ..sources import events as EV
from ..sources import files as FS
from ..sources import registry as RS
from ..streaming import gate as GT
from ..streaming import messages as SM
from . import standins as SI
from .installation import run_installation

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------------------
# Messages (P1-P4, W2)
# ---------------------------------------------------------------------------

def _normalized_messages(spark, d):
    return M.normalize_codes(SI.messages(spark, d), command_col=None)


def q_msg_accept(spark: SparkSession, d: str) -> DataFrame:
    """P1 + P2: messages of known clients that pass the checksum gate."""
    acc = M.accept_messages(_normalized_messages(spark, d), SI.clients(spark, d))
    return acc.select("msg_seq", "client_id", "message_id", "type_message", "checksum")


def q_msg_accept_asof(spark: SparkSession, d: str) -> DataFrame:
    """P1 + P2 with the hash as it was when the message came (clicks change it)."""
    acc = M.accept_messages_asof(_normalized_messages(spark, d), SI.registry_changes(spark, d), id_cols=("msg_seq",),
                                 change_order=["change_id"])
    return acc.select("msg_seq", "client_id", "message_id", "type_message", "checksum")


def q_msg_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First message per (client, message id, type) by arrival, then sequence."""
    dd = M.dedup_messages(_normalized_messages(spark, d), order=("arrival_ts", "msg_seq"))
    return dd.select("msg_seq", "client_id", "message_id", "type_message", "arrival_ts")


def q_msg_dedup_history(spark: SparkSession, d: str) -> DataFrame:
    """W2 with the agent's bounded history (the headers of a client: 20, cut to 2)."""
    msgs = _normalized_messages(spark, d)
    dd = M.dedup_history(msgs, order=("arrival_ts", "msg_seq"), limit=20)
    return dd.select("msg_seq", "client_id", "message_id", "type_message")


def q_msg_route(spark: SparkSession, d: str) -> DataFrame:
    """P3 -> P1/P2 -> W2 -> P4: accepted, de-duplicated messages counted per route."""
    acc = M.accept_messages(_normalized_messages(spark, d), SI.clients(spark, d))
    dd = M.dedup_messages(acc, order=("arrival_ts", "msg_seq"))
    routed = M.route(dd)
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n_messages"))


# ---------------------------------------------------------------------------
# Documents (W1, J1, J2, J6, J9) and outcomes
# ---------------------------------------------------------------------------

EVENT_TS = "2024-02-01 00:00:00"  # fixed creation time of status rows, so reruns repeat


def q_products_first(spark: SparkSession, d: str) -> DataFrame:
    """First app per (document, product name) in line order."""
    apps = SI.line_apps(spark, d).select("msg_id", F.col("brand").alias("productname"), "version", "itemVersion",
                                         *SI.LINE_ORDER)
    first = D.first_products(apps, name_col="productname", order=SI.LINE_ORDER)
    return first.select("msg_id", "productname", "version", "itemVersion", "l_linenumber")


def q_group_expand(spark: SparkSession, d: str) -> DataFrame:
    """J1 + T6: group apps replaced by their items; a missing variant is an error row."""
    apps = SI.line_apps(spark, d).select(
        "msg_id", *SI.LINE_ID, F.col("ptype").alias("productname"),
        F.when(F.col("l_returnflag") == "R", F.lit("reports")).otherwise(F.lit("web")).alias("type"),
        "version", "itemVersion")
    groups, contexts = SI.standin_groups()
    out = D.expand_groups(apps, groups, contexts, expandable=SI.STANDIN_EXPANDABLE,
                          copy_cols=("version", "itemVersion"))
    return out.select("msg_id", *SI.LINE_ID, "productname", "type", "context", "version",
                      "itemVersion", "item_pos", "_error")


def q_phase_plan(spark: SparkSession, d: str) -> DataFrame:
    """Phases with their server visits; phases without any kept only when AGENT."""
    ph, en = SI.plan_rows(spark, d)
    ph = ph.withColumn("type", F.upper("type"))
    plan = D.plan_phases(D.phases_from_rows(ph), en)
    return plan.select(F.col("id").alias("phase_id"), F.col("type").alias("phase_type"), "n_servers")


def _line_exit(flag_col="l_returnflag"):
    return (F.when(F.col(flag_col) == "R", 1).when(F.col(flag_col) == "A", 0)
            .otherwise(F.lit(None)).cast("int"))


def q_fail_stop(spark: SparkSession, d: str) -> DataFrame:
    """Steps of each document up to and including its first failing step."""
    st = SI.line_steps(spark, d).withColumn(
        "exit_status", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    kept = O.fail_stop(st, order=SI.LINE_ORDER)
    return kept.select("msg_id", *SI.LINE_ORDER, "exit_status", "failed_here")


def q_step_logs(spark: SparkSession, d: str) -> DataFrame:
    """Log rows of the steps that ran: INFO per passed step, ERROR for the failing one."""
    st = SI.line_steps(spark, d).withColumn(
        "exit_status", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    kept = O.fail_stop(st, order=SI.LINE_ORDER).withColumn("client_id", F.col("msg_id").cast("string")) \
        .withColumn("execution_plan", F.lit("lines")) \
        .withColumn("_text", F.concat(F.lit("line "), F.col("l_linenumber"), F.lit(" part "), F.col("l_partkey")))
    level = F.when(F.col("failed_here"), F.lit("ERROR")).otherwise(F.lit("INFO"))
    return O.log_events(kept, level, "_text", logged_at=EVENT_TS)


def q_phase_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Phases that ran nothing reuse the previous response; none -> error row."""
    st = SI.line_steps(spark, d).withColumn("exit_status", _line_exit())
    out = O.phase_outcome(st, order=SI.LINE_ORDER, status_error=F.lit("error"),
                          status_complete=F.lit("complete"))
    return out.select("msg_id", *SI.LINE_ID, "exit_status", "effective_exit", "exit_source",
                      "phase_status", "_error")


def q_status_events(spark: SparkSession, d: str) -> DataFrame:
    """Start and result rows per (phase, first-wins product) of each document."""
    apps = SI.line_apps(spark, d).select(
        "msg_id", *SI.LINE_ORDER, F.col("brand").alias("name"), "itemVersion",
        F.col("l_linestatus").alias("environment"))
    products = D.first_products(apps, name_col="name", order=SI.LINE_ORDER) \
        .select("msg_id", "name", "itemVersion", "environment")
    ev = D.status_events(SI.order_phases(spark, d), products, created_at=EVENT_TS)
    return ev


def q_script_index(spark: SparkSession, d: str) -> DataFrame:
    """Script name -> package of the greatest position (a later package overwrites)."""
    idx = D.script_index(SI.part_scripts(spark, d))
    return idx.select("name", "package", "pos")


# ---------------------------------------------------------------------------
# Catalog (A1, A3, A5, A6, T2-T5, W7) and rules
# ---------------------------------------------------------------------------

TABLESPACE_STANDIN_RULES = [("PROMO", 3000), ("SMALL", 2000000000), ("ABSENT", 1)]


def q_tablespace(spark: SparkSession, d: str) -> DataFrame:
    """A1: max MB per tablespace over data and temp files (temp headers fan out)."""
    f = SI.file_catalog(spark, d)
    # Ordered by name at the sink (a handful of rows).
    return C.tablespace_capacity(names=SI.TABLESPACE_NAMES, **f).orderBy("tablespace_name")


def q_tablespace_check(spark: SparkSession, d: str) -> DataFrame:
    """Rule tablespaces missing / undersized / ok against the A1 result."""
    cap = q_tablespace(spark, d)
    return R.tablespace_check(cap, rules=TABLESPACE_STANDIN_RULES)


def q_grant_gap(spark: SparkSession, d: str) -> DataFrame:
    """A3: GRANT statements for objects with too few grants (views twice)."""
    return C.grant_gap(SI.customer_objects(spark, d), SI.order_grants(spark, d))


def q_not_in(spark: SparkSession, d: str) -> DataFrame:
    """DBAMV tables and views without a public synonym (NULL-aware NOT IN)."""
    return C.synonym_gap_tables(SI.customer_objects(spark, d), SI.order_synonyms(spark, d))


def q_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """T4: code objects and sequences without a public synonym (NOT EXISTS)."""
    return C.synonym_gap_objects(SI.part_objects(spark, d), SI.line_synonyms(spark, d))


def q_fk_gap(spark: SparkSession, d: str) -> DataFrame:
    """CREATE INDEX statements for foreign keys no index covers (MINUS, join back)."""
    cons, idx = SI.fk_catalog(spark, d)
    return C.fk_index_gap(cons, idx)


def q_column_list(spark: SparkSession, d: str) -> DataFrame:
    """Comma-joined column names per key in position order."""
    return C.column_list(SI.line_key_columns(spark, d), ["constraint_name"])


def q_privileges(spark: SparkSession, d: str) -> DataFrame:
    """T5 + J8: required privileges a user lacks; the first one is the reported one."""
    users, tab, role = SI.event_privileges(spark, d)
    privs = C.user_privileges(tab, role, keys=["user_id"])
    return R.privilege_gap(users, privs, keys=["user_id"]).select("user_id", "NAME", "value", "rule_pos", "reported")


def q_audit_tail(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 audit rows (events)."""
    ev = SI.read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return C.audit_tail(ev, ts_col="ts", id_col="event_id")


def q_audit_tail_client(spark: SparkSession, d: str) -> DataFrame:
    """W7 for many sources: the newest 20 rows of each client (user)."""
    ev = SI.read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return C.audit_tail(ev, n=20, ts_col="ts", id_col="event_id", keys=["user_id"])


def q_registry_exists(spark: SparkSession, d: str) -> DataFrame:
    """A5: per environment (user), does the registry table exist among its objects?"""
    ev = SI.read_table(spark, d, "events")
    k = SI.event_k()
    objs = ev.select(
        "user_id", F.when((F.col("event_type") == "view") & (k < 20), F.lit("GCM_VERSAO")).otherwise(F.concat(F.lit("OBJ"), k)).alias("object_name"),
        F.when(k % 2 == 0, F.lit("DBAMV")).otherwise(F.lit("DBAPS")).alias("owner"))
    envs = ev.select("user_id").distinct()
    return C.registry_exists(envs, objs, ["user_id"])


def q_registry(spark: SparkSession, d: str) -> DataFrame:
    """Replace registry rows by product key with the latest update."""
    old, new = SI.event_registry(spark, d, split_at="2024-01-16")
    out = O.replace_by_key(old.drop("event_id"), new, ["cd_produto"],
                           update_order=["dh_atualizacao", "event_id"])
    return out.select("cd_produto", "ds_versao", "dh_atualizacao", "origin")


def q_registry_store(spark: SparkSession, d: str) -> DataFrame:
    """U1 / U2 as a stored table: two rounds of updates (events) into its touched partitions; users without
    the registry table get none (A5)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/registry/{uuid.uuid4().hex}"
    key = ["user_id", "cd_produto"]

    def with_user(rows: DataFrame) -> DataFrame:
        return rows.withColumn("user_id", F.split_part("cd_produto", F.lit(":"), F.lit(1)).cast("long"))

    old, later = SI.event_registry(spark, d, split_at="2024-01-08")
    RS.create_registry(with_user(O.replace_by_key(old.limit(0), old, ["cd_produto"], update_order=["dh_atualizacao", "event_id"])
                                 .drop("event_id", "origin")), path, key)
    have = q_registry_exists(spark, d)
    at = F.lit("2024-01-20").cast("timestamp_ntz")
    for part in (later.where(F.col("dh_atualizacao") < at), later.where(F.col("dh_atualizacao") >= at)):
        RS.update_registry(spark, with_user(part), path, key, ["dh_atualizacao", "event_id"], registries=have)
    return RS.read_registry(spark, path).select("cd_produto", "ds_versao", "dh_atualizacao")


def q_snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Orders as snapshot rows in three generations, the last one never committed; what is read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/snapshots/{uuid.uuid4().hex}"
    o = SI.read_table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("client_id"), F.lower("o_orderpriority").alias("environment"),
        F.col("o_orderkey").alias("srv_pos"), F.year("o_orderdate").alias("_year"))
    FS.save_snapshot(o.where("_year < 1997").drop("_year"), path, 1)
    FS.save_snapshot(o.where("_year BETWEEN 1997 AND 1998").drop("_year"), path, 2)
    FS.write_generation(o.where("_year > 1998").drop("_year"), path, 3)  # its writer dies before the commit
    return FS.load_snapshot(spark, path).select("client_id", "environment", "srv_pos", "generation")


def q_run_durations(spark: SparkSession, d: str) -> DataFrame:
    """Durations of runs: per user a purchase starts one and a signup ends it."""
    ev = SI.read_table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "start").when(F.col("event_type") == "signup", "end")
    runs = O.run_durations(ev.select("user_id", "event_id", "ts", kind.alias("kind")), keys=["user_id"], tie=["event_id"])
    return runs.select("user_id", "start_ts", "end_ts", "hours", "minutes", "seconds")


def q_disk(spark: SparkSession, d: str) -> DataFrame:
    """A4 + F2: largest partition of each node and its free MB against 150 MB."""
    out = R.disk_check(SI.event_devices(spark, d), ["node"], 150)
    return out.select("node", "device", "kb_size", "kb_available", "free_mb", "passed")


def q_verdict(spark: SparkSession, d: str) -> DataFrame:
    """A2: per document (customer) no rule failed; documents without results pass."""
    ev = SI.read_table(spark, d, "events")
    results = ev.select(F.col("user_id").alias("msg_id"), F.lit("CHECK_SERVERS_DISK_SPACE").alias("rule"),
                        (F.col("value") < 150).alias("passed"))
    docs = SI.read_table(spark, d, "customer").select(F.col("c_custkey").alias("msg_id"))
    return R.validation_verdict(results, docs).select("msg_id", "verdict", "n_rules", "n_failed")


def q_version_check(spark: SparkSession, d: str) -> DataFrame:
    """CHECK_AGENT_VERSION requests (events) against the client's installed version."""
    ev = SI.read_table(spark, d, "events")
    req = ev.select("event_id", F.col("user_id").alias("client_id"),
                    F.concat(F.lit("v"), SI.event_k() % 3).alias("metric"))
    agents = SI.read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("client_id"), F.concat(F.lit("v"), F.col("c_nationkey") % 3).alias("agent_version"))
    return R.version_check(req, agents).select("event_id", "client_id", "metric", "agent_version", "passed")


# ---------------------------------------------------------------------------
# Scripts and artifacts
# ---------------------------------------------------------------------------

def q_statements(spark: SparkSession, d: str) -> DataFrame:
    """audit scripts split into statements on "/" lines."""
    return X.statements(SI.turn_scripts(spark, d))


def q_statements_docs(spark: SparkSession, d: str) -> DataFrame:
    """F1 on whole document texts (each script is one row; no shuffle)."""
    return X.statements(SI.document_scripts(spark, d))


def q_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Artifact md5 against the first line of its published .md5 file."""
    art, exp = SI.document_artifacts(spark, d)
    return X.fingerprint_check(art, exp)


# ---------------------------------------------------------------------------
# Topology (J3, W6, J4)
# ---------------------------------------------------------------------------

TOPO_APP = ["l_orderkey", "l_linenumber", "l_partkey"]
TOPO_COLS = ["balancer_host", "balancer_port", "server_host", "srv_pos", "port", "product_name",
             "product_type", *TOPO_APP]


def q_topology(spark: SparkSession, d: str) -> DataFrame:
    """J3 + W6: flat balancer topology; duplicate hosts keep their first entry."""
    b, s, p, a = SI.topology_inputs(spark, d)
    topo = TP.balancer_topology(b, s, p, a, app_cols=TOPO_APP)
    return topo.select(*TOPO_COLS)


def q_balancer_for_server(spark: SparkSession, d: str) -> DataFrame:
    """The balancers whose host equals a server's host (customers as servers in their nation)."""
    balancers = SI.topology_inputs(spark, d, stored=False)[0]
    c = SI.read_table(spark, d, "customer")
    n = SI.read_table(spark, d, "nation")
    srv = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.lit("topo").alias("msg_id"), F.col("c_custkey").alias("srv_pos"), F.col("n_name").alias("server_host"))
    out = D.balancer_for_server(srv, balancers)
    return out.select("srv_pos", "server_host", "balancer_port")


def q_topology_merge(spark: SparkSession, d: str) -> DataFrame:
    """The topology of lines from 1998 merged with the snapshot of earlier lines."""
    # Both periods are documents of one topology job, materialised once; the old
    # document plays the stored snapshot of the same environment.
    both = TP.balancer_topology(*SI.topology_inputs(spark, d, split_at="1998-01-01"), app_cols=TOPO_APP)
    both = materialize_table(both.withColumn("environment", F.lit("topo")))
    new, old = both.where(F.col("msg_id") == "new"), both.where(F.col("msg_id") == "old")
    merged = TP.merge_topology(new, old, keys=["environment"], order=["srv_pos", *TOPO_APP], materialize=False)
    return merged.select(*TOPO_COLS, "origin", "returned")


# ---------------------------------------------------------------------------
# Installation flow
# ---------------------------------------------------------------------------

def _flow(spark: SparkSession, d: str):
    msgs, outcomes = SI.order_installations(spark, d)
    docs = M.parse_body(M.route(M.normalize_codes(msgs)), "INSTALLATION")
    docs = materialize_table(docs.select("msg_id", "client_id", "environment", "execution_plan", "command", "arrival_ts", "doc", "_corrupt"))
    return run_installation(docs, outcomes, created_at=EVENT_TS, observations=R.Observations(agents=SI.client_agents(spark, d)),
                            order=("arrival_ts", "msg_id"))


def q_parse_body(spark: SparkSession, d: str) -> DataFrame:
    """S2 + P6 + P8: parsed installation bodies; corrupt ones only leave a hash and a length."""
    msgs, _ = SI.order_installations(spark, d)
    docs = M.parse_body(M.route(M.normalize_codes(msgs)), "INSTALLATION")
    kept = holds_text(F.col("doc"), docs.schema["doc"].dataType, "secret") | F.coalesce(F.col("_corrupt").contains("secret"), F.lit(False))
    return docs.select(
        "msg_id", "command", F.col("_corrupt").isNotNull().alias("corrupt"),
        F.size("doc.list_server").alias("n_servers"),
        F.aggregate("doc.list_server", F.lit(0), lambda n, s: n + F.size(s["app_list"])).alias("n_apps"),
        F.size("doc.executionPlan").alias("n_phases"), F.size("doc.validations").alias("n_rules"),
        kept.alias("shows_password"))


def q_flow_errors(spark: SparkSession, d: str) -> DataFrame:
    """Messages that did not run, or not to their end, and why."""
    return _flow(spark, d).errors


def q_flow_steps(spark: SparkSession, d: str) -> DataFrame:
    """P7 + W3 + W5: the steps that ran, by text phase id; a missing outcome stops its message."""
    return _flow(spark, d).steps.select("msg_id", "phase_id", "srv_pos", "visit_pos", "entry_pos", "rec_pos", "recipe",
                                        "exit_status", "failed_here", "is_balancer", "_error")


def q_flow_status(spark: SparkSession, d: str) -> DataFrame:
    """Environment-item rows of the completed phases."""
    return _flow(spark, d).status_events


def q_flow_server_events(spark: SparkSession, d: str) -> DataFrame:
    """J6 (servers): rows per app of each visited server."""
    return _flow(spark, d).server_events


def q_flow_logs(spark: SparkSession, d: str) -> DataFrame:
    """Start and result of each step, and how each message ended."""
    return _flow(spark, d).logs


def q_flow_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows of the messages that completed an install, with their client and environment."""
    return _flow(spark, d).registry_updates


FLOW_TOPO = ["client_id", "environment", "balancer_host", "balancer_port", "server_host", "srv_pos", "port", "product_name",
             "product_context", "product_type", "app_pos", "item_pos"]


def q_flow_topology(spark: SparkSession, d: str) -> DataFrame:
    """J3 + W6 + J4 as a chain: each topology row and the messages, by their place in the client's
    environment, whose snapshot holds it."""
    return _flow(spark, d).topology_history.select(*FLOW_TOPO, "from_seq", "until_seq")


def q_flow_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The merged topology that each message leaves."""
    return _flow(spark, d).topology.select("msg_id", "bal_pos", *FLOW_TOPO, "origin", "returned")


def q_disk_nodes(spark: SparkSession, d: str) -> DataFrame:
    """nodes by their Ruby-hash attributes; every node is judged, readable or not."""
    nodes = SI.order_nodes(spark, d)
    nodes = nodes.withColumn("drive", R.home_drive(nodes))
    out = R.disk_check(R.parse_filesystem(nodes), ["server_host"], 40, "server_type", "drive")
    return out.select("server_host", "server_type", "device", "free_mb", "passed", "_error", "message")


def q_client_registry(spark: SparkSession, d: str) -> DataFrame:
    """The client registry after its latest updates (events): one row per client."""
    ev = SI.read_table(spark, d, "events")
    k = SI.event_k()
    old = SI.client_agents(spark, d).join(SI.clients(spark, d), "client_id")
    new = ev.select(F.col("user_id").cast("string").alias("client_id"), F.concat(F.lit("v"), k % 3).alias("agent_version"),
                    (k % 2).cast("string").alias("env_hash"), "ts", "event_id")
    return O.replace_by_key(old, new, ["client_id"], update_order=["ts", "event_id"])


def q_stream_route(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of message files, drained through the front end and the
    fan-out; the written messages counted per route. The watermark spans all events, so no
    row is late and the counts equal those of the batch form."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    msgs = SI.messages(spark, d)
    rows = msgs.select(*[
        (F.col(f.name) if f.name in msgs.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in S.MESSAGE_SCHEMA.fields])
    rows.write.parquet(f"{root}/in")
    stream = SM.message_stream(spark, f"{root}/in", SI.clients(spark, d), watermark="3650 days", fmt="parquet")
    SM.start_fan_out(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("route").agg(F.count(F.lit(1)).alias("n_messages"))


def q_script_packages(spark: SparkSession, d: str) -> DataFrame:
    """S4 + J9: the scripts of zip packages (documents) by name, last entry wins; a broken package is an error row."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/packages/{uuid.uuid4().hex}"
    packages = SI.document_packages(spark, d, folder)
    scripts = materialize_table(X.scan_packages(spark, f"{folder}/p*.zip", packages))
    kept = X.package_scripts(scripts).withColumn("md5", F.md5(F.encode("content", S.SCRIPT_ENCODING))) \
        .withColumn("n_chars", F.length("content"))
    broken = scripts.where(F.col("_error").isNotNull())
    cols = ["filename", "productName", "name", "name_pos", "entry_pos", "n_chars", "md5"]
    per = X.scripts_per_package(scripts).select("filename", "n_scripts")
    return kept.select(*cols, "_error").unionByName(broken.select("filename", "productName", "_error"), allowMissingColumns=True) \
        .join(per, "filename").select(*cols, "n_scripts", F.col("_error").isNotNull().alias("broken"))


def q_event_sink(spark: SparkSession, d: str) -> DataFrame:
    """The step logs written to the committed sink, and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/events/{uuid.uuid4().hex}"
    logs = q_step_logs(spark, d)
    EV.write_committed(logs, path, "1")
    return EV.read_committed(spark, path, logs.schema)


def q_stream_gate(spark: SparkSession, d: str) -> DataFrame:
    """X2 + X4: the events as a stream that arrives in parts, with a watermark of a day: status of every message.

    Each part is written and drained in turn, so a part is a micro-batch. A last change far ahead
    moves the watermark past all rows.
    """
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    msgs = _normalized_messages(spark, d)
    msgs = msgs.withColumn("part", SI.arrival_part("arrival_ts", F.col("message_id").cast("int") % 10 == 7))
    changes = SI.registry_changes(spark, d).withColumn("part", SI.arrival_part("changed_ts", F.lit(False)))
    end = spark.range(1).select(F.lit("-").alias("client_id"), F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("changed_ts"),
                                F.lit(None).cast("string").alias("env_hash"), F.lit(-1).cast("long").alias("change_id"))
    for part in range(len(SI.ARRIVAL_DAYS) + 1):
        news = changes.where(F.col("part") == part).drop("part")
        msgs.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/messages")
        (news.unionByName(end) if part == len(SI.ARRIVAL_DAYS) else news).write.mode("append").parquet(f"{root}/changes")
        arriving = spark.readStream.schema(msgs.drop("part").schema).parquet(f"{root}/messages")
        changing = spark.readStream.schema(end.schema).parquet(f"{root}/changes")
        stream = GT.gated_stream(arriving, changing, watermark=SI.STREAM_DELAY, keep_seconds=SI.STREAM_KEEP_DAYS * 86400, tie_col="msg_seq",
                                 change_tie_col="change_id")
        with GT.rocksdb_state(spark):
            stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint") \
                .trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        F.get_json_object("payload", "$.msg_seq").cast("long").alias("msg_seq"), "client_id", "status")


QUERIES: dict[str, Query] = {
    "msg_accept": q_msg_accept,
    "msg_accept_asof": q_msg_accept_asof,
    "msg_dedup": q_msg_dedup,
    "msg_dedup_history": q_msg_dedup_history,
    "msg_route": q_msg_route,
    "products_first": q_products_first,
    "group_expand": q_group_expand,
    "phase_plan": q_phase_plan,
    "fail_stop": q_fail_stop,
    "phase_outcome": q_phase_outcome,
    "step_logs": q_step_logs,
    "status_events": q_status_events,
    "script_index": q_script_index,
    "tablespace": q_tablespace,
    "tablespace_check": q_tablespace_check,
    "grant_gap": q_grant_gap,
    "not_in": q_not_in,
    "not_exists": q_not_exists,
    "fk_gap": q_fk_gap,
    "column_list": q_column_list,
    "privileges": q_privileges,
    "audit_tail": q_audit_tail,
    "audit_tail_client": q_audit_tail_client,
    "registry_exists": q_registry_exists,
    "registry": q_registry,
    "registry_store": q_registry_store,
    "snapshot_roundtrip": q_snapshot_roundtrip,
    "run_durations": q_run_durations,
    "disk": q_disk,
    "verdict": q_verdict,
    "version_check": q_version_check,
    "statements": q_statements,
    "statements_docs": q_statements_docs,
    "fingerprint": q_fingerprint,
    "topology": q_topology,
    "topology_merge": q_topology_merge,
    "balancer_for_server": q_balancer_for_server,
    "parse_body": q_parse_body,
    "flow_errors": q_flow_errors,
    "flow_steps": q_flow_steps,
    "flow_status": q_flow_status,
    "flow_server_events": q_flow_server_events,
    "flow_logs": q_flow_logs,
    "flow_registry": q_flow_registry,
    "flow_topology": q_flow_topology,
    "flow_snapshots": q_flow_snapshots,
    "disk_nodes": q_disk_nodes,
    "client_registry": q_client_registry,
    "stream_route": q_stream_route,
    "stream_gate": q_stream_gate,
    "script_packages": q_script_packages,
    "event_sink": q_event_sink,
}
