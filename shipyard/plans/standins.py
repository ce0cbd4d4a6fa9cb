"""Stand-in inputs built from the driver's tables.

Each builder only reshapes driver rows into the schema an operator expects
(renames, casts, fixed code mappings). It does none of the operator's work: the
query functions in ``plans.queries`` call the same library operators that run
on real deployment inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import materialize_table
from ..sources.files import read_table

# ---------------------------------------------------------------------------
# Fixed stand-in mappings (chosen once; the oracle SQL uses the same values)
# ---------------------------------------------------------------------------

# event_type -> header text of a message type (lower case, as senders write it);
# "error" is not a message type and normalises to UNKNOWN.
EVENT_AS_MESSAGE = [
    ("purchase", "installation"),
    ("signup", "bootstrap"),
    ("click", "check_database"),
    ("view", "database_audit_information"),
    ("error", "error"),
]


def _case(col: str, pairs, default=None):
    expr = F.lit(default)
    for k, v in reversed(pairs):
        expr = F.when(F.col(col) == F.lit(k), F.lit(v)).otherwise(expr)
    return expr


def event_k(col: str = "props"):
    return F.get_json_object(F.col(col), "$.k").cast("int")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """events -> messages: user = client, k = message id, k % 2 = checksum, ts = arrival."""
    ev = read_table(spark, d, "events")
    k = event_k()
    return ev.select(
        F.col("event_id").alias("msg_seq"),
        F.col("user_id").cast("string").alias("client_id"),
        k.cast("string").alias("message_id"),
        (k % 2).cast("string").alias("checksum"),
        _case("event_type", EVENT_AS_MESSAGE).alias("type_message"),
        F.col("ts").alias("arrival_ts"),
    )


def clients(spark: SparkSession, d: str) -> DataFrame:
    """customer -> client registry: custkey = client, nationkey % 2 = stored hash."""
    c = read_table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("client_id"),
                    (F.col("c_nationkey") % 2).cast("string").alias("env_hash"))


def registry_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the client registry: customers of odd key stand in it from the start, and every
    click (event) sets its user's hash to k % 2."""
    start = clients(spark, d).where(F.col("client_id").cast("long") % 2 == 1).select(
        "client_id", F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").alias("changed_ts"), "env_hash", F.lit(-1).cast("long").alias("change_id"))
    ev = read_table(spark, d, "events").where(F.col("event_type") == "click")
    return start.unionByName(ev.select(F.col("user_id").cast("string").alias("client_id"), F.col("ts").cast("timestamp_ntz").alias("changed_ts"),
                                       (event_k() % 2).cast("string").alias("env_hash"), F.col("event_id").alias("change_id")))


#: The gated stream: events arrive in so many parts, by time; a message whose k ends in 7 comes one part later.
ARRIVAL_DAYS = [10, 20, 40]
STREAM_DELAY = "1 day"
STREAM_KEEP_DAYS = 3


def arrival_part(ts: str, late: F.Column) -> F.Column:
    day = F.datediff(F.col(ts), F.lit("2024-01-01").cast("timestamp_ntz"))
    part = F.lit(len(ARRIVAL_DAYS))
    for k, until in reversed(list(enumerate(ARRIVAL_DAYS))):
        part = F.when(day < until, k).otherwise(part)
    return part + late.cast("int")


# ---------------------------------------------------------------------------
# Documents: an order is a document, its lines are apps / steps
# ---------------------------------------------------------------------------

# Line order inside an order; (l_orderkey, l_linenumber) alone is not unique.
LINE_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
LINE_ID = ["l_linenumber", "l_partkey", "l_suppkey"]

# Product groups of the stand-in: p_type names play group apps; a line with return
# flag R asks for the "reports" variant, which only PROMO has.
STANDIN_EXPANDABLE = ["PROMO", "SMALL"]
STANDIN_GROUPS = [
    ("PROMO", ["PROMO-BOX", "PROMO-BAG"]),
    ("PROMO_REPORTS", ["PROMO-REPORT"]),
    ("SMALL", ["SMALL-CASE", "SMALL-PACK", "SMALL-JAR"]),
]
STANDIN_CONTEXTS = [
    ("PROMO_BOX", "promo-box"),
    ("PROMO_BAG", "promo-bag"),
    ("PROMO_REPORT", "promo-report"),
    ("SMALL_CASE", "small-case"),
    ("SMALL_PACK", "small-pack"),
]


def line_apps(spark: SparkSession, d: str) -> DataFrame:
    """lineitem + part -> apps of a document: order = msg_id, part = app."""
    li = read_table(spark, d, "lineitem")
    p = read_table(spark, d, "part")
    a = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return a.select(
        F.col("l_orderkey").alias("msg_id"), *LINE_ORDER, "l_returnflag", "l_linestatus",
        F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"),
        F.col("p_name").alias("version"), F.col("l_partkey").cast("string").alias("itemVersion"))


def standin_groups() -> tuple[dict[str, list[str]], dict[str, str]]:
    return dict(STANDIN_GROUPS), dict(STANDIN_CONTEXTS)


def plan_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """orders -> plan actions of one document; lines -> run-list entries.

    An entry of a line with return flag R carries its order's phase id, the others the
    id of a phase that the plan lacks (order key and flag).
    """
    o = read_table(spark, d, "orders")
    li = read_table(spark, d, "lineitem")
    ph = o.select(F.lit("plan").alias("msg_id"), F.col("o_orderkey").cast("string").alias("id"),
                  F.when(F.col("o_orderpriority") == "5-LOW", F.lit("agent")).otherwise(F.lit("chef"))
                  .alias("type"))
    order = F.col("l_orderkey").cast("string")
    en = li.select(
        F.lit("plan").alias("msg_id"),
        F.when(F.col("l_returnflag") == "R", order).otherwise(F.concat(order, "l_returnflag")).alias("id"),
        F.col("l_suppkey").alias("srv"))
    return ph, en


def line_steps(spark: SparkSession, d: str) -> DataFrame:
    """lineitem -> ordered steps of a document (order); exit from the return flag."""
    li = read_table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("msg_id"), *LINE_ORDER, "l_returnflag")


def order_phases(spark: SparkSession, d: str) -> DataFrame:
    """orders -> one phase per document with status texts; exit 0 when status F."""
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("msg_id"), F.col("o_orderkey").cast("string").alias("phase_id"),
        F.lit("start").alias("statusInitial"), F.lit("done").alias("statusComplete"),
        F.lit("fail").alias("statusError"), F.lit("0").alias("initialProgress"),
        F.lit("100").alias("finalProgress"), F.col("o_orderpriority").alias("initialDescription"),
        F.lit("finished").alias("finalDescription"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("exit_status"),
        F.col("o_custkey").cast("string").alias("client_id"),
        F.col("o_orderpriority").alias("execution_plan"))


def part_scripts(spark: SparkSession, d: str) -> DataFrame:
    """part -> scripts of packages: name = p_name, package = p_brand, position = p_partkey."""
    p = read_table(spark, d, "part")
    return p.select(F.lit("pkgs").alias("msg_id"), F.col("p_name").alias("name"),
                    F.col("p_brand").alias("package"), F.col("p_partkey").alias("pos"))


# ---------------------------------------------------------------------------
# Catalog extracts
# ---------------------------------------------------------------------------

# Owner of a stand-in object: position key % 5 in this list (the last is outside
# the four grant owners, so filters have something to drop).
STANDIN_OWNERS = ["DBAMV", "DBASGU", "DBAPS", "MVINTEGRA", "SYSTEM"]
# Grantee of a stand-in grant: order key % 5 in this list.
STANDIN_GRANTEES = ["DBAMV", "DBASGU", "DBAPS", "MVINTEGRA", "MV2000"]
SEGMENT_AS_TYPE = [("AUTOMOBILE", "VIEW"), ("BUILDING", "SEQUENCE"), ("FURNITURE", "FUNCTION"),
                   ("HOUSEHOLD", "PACKAGE"), ("MACHINERY", "TABLE")]
STATUS_AS_PRIVILEGE = [("F", "EXECUTE"), ("O", "SELECT"), ("P", "INSERT")]
PTYPE_AS_TYPE = [("PROMO", "FUNCTION"), ("SMALL", "PROCEDURE"), ("MEDIUM", "PACKAGE"), ("LARGE", "SEQUENCE"),
                 ("STANDARD", "TABLE"), ("ECONOMY", "VIEW")]
FK_STANDIN_OWNERS = ["DBAMV", "DBASGU", "DBAPS"]
TABLESPACE_NAMES = ["PROMO", "SMALL", "TEMP"]
TEMP_TABLESPACES = ["PROMO", "SMALL", "TEMP"]


def _pick(col, values):
    """values[col % len(values)] as a column."""
    expr = F.lit(None).cast("string")
    for i, v in reversed(list(enumerate(values))):
        expr = F.when((col % len(values)) == i, F.lit(v)).otherwise(expr)
    return expr


def customer_objects(spark: SparkSession, d: str) -> DataFrame:
    """customer -> catalog objects: name C<custkey>, owner by custkey, type by segment."""
    c = read_table(spark, d, "customer")
    return c.select(_pick(F.col("c_custkey"), STANDIN_OWNERS).alias("owner"),
                    F.concat(F.lit("C"), F.col("c_custkey")).alias("object_name"),
                    _case("c_mktsegment", SEGMENT_AS_TYPE).alias("object_type"))


def order_grants(spark: SparkSession, d: str) -> DataFrame:
    """orders -> grants on the customer's object: grantee by orderkey, privilege by status."""
    o = read_table(spark, d, "orders")
    return o.select(_pick(F.col("o_custkey"), STANDIN_OWNERS).alias("owner"),
                    F.concat(F.lit("C"), F.col("o_custkey")).alias("table_name"),
                    _pick(F.col("o_orderkey"), STANDIN_GRANTEES).alias("grantee"),
                    _case("o_orderstatus", STATUS_AS_PRIVILEGE).alias("privilege"))


def order_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """orders -> synonyms of the customer's object; public for status P."""
    o = read_table(spark, d, "orders")
    return o.select(F.when(F.col("o_orderstatus") == "P", F.lit("PUBLIC")).otherwise(F.lit("DBAMV")).alias("owner"),
                    F.concat(F.lit("C"), F.col("o_custkey")).alias("table_name"),
                    _pick(F.col("o_custkey"), STANDIN_OWNERS).alias("table_owner"))


def part_objects(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(_pick(F.col("p_partkey"), STANDIN_OWNERS).alias("owner"),
                    F.concat(F.lit("P"), F.col("p_partkey")).alias("object_name"),
                    _case("p_type", PTYPE_AS_TYPE).alias("object_type"))


def line_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """lineitem -> synonyms of the part's object; public for returned lines (R) of quantity over 45."""
    li = read_table(spark, d, "lineitem")
    public = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    return li.select(F.when(public, F.lit("PUBLIC")).otherwise(F.lit("DBAMV")).alias("owner"),
                     F.concat(F.lit("P"), F.col("l_partkey")).alias("table_name"),
                     _pick(F.col("l_partkey"), STANDIN_OWNERS).alias("table_owner"))


def fk_catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """lineitem -> constraints (flag R: foreign keys, N: other) and indexes (flag A).

    Table = T<suppkey>, column list = C<partkey>, owner by orderkey.
    """
    li = read_table(spark, d, "lineitem")
    owner = _pick(F.col("l_orderkey"), FK_STANDIN_OWNERS)
    table = F.concat(F.lit("T"), F.col("l_suppkey"))
    cols = F.concat(F.lit("C"), F.col("l_partkey"))
    cons = li.where(F.col("l_returnflag").isin("R", "N")).select(
        owner.alias("owner"), table.alias("table_name"),
        F.concat_ws("_", table, F.col("l_orderkey"), F.col("l_linenumber"), F.lit("FK")).alias("constraint_name"),
        F.when(F.col("l_returnflag") == "R", F.lit("R")).otherwise(F.lit("P")).alias("constraint_type"),
        cols.alias("colunas"))
    idx = li.where(F.col("l_returnflag") == "A").select(
        owner.alias("owner"), table.alias("table_name"),
        F.concat_ws("_", table, F.col("l_orderkey"), F.col("l_linenumber"), F.lit("IX")).alias("index_name"),
        cols.alias("colunas"))
    return cons, idx


def line_key_columns(spark: SparkSession, d: str) -> DataFrame:
    """lineitem -> key columns: constraint = order, column = C<partkey>, position = line number."""
    li = read_table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("constraint_name"),
                     F.concat(F.lit("C"), F.col("l_partkey")).alias("column_name"),
                     F.col("l_linenumber").alias("position"))


def file_catalog(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """part = data files (p_type tablespace, p_size MB); supplier = temp files; lines = free
    space and temp headers (so a file id repeats). A fifth of the data files and a quarter of
    the temp files stand in their view under another name or number, so they do not count."""
    p = read_table(spark, d, "part")
    s = read_table(spark, d, "supplier")
    li = read_table(spark, d, "lineitem")
    mb = F.lit(1024 * 1024)
    fname = F.concat(F.lit("/data/df"), F.col("p_partkey"))
    return {
        "data_files": p.select(F.col("p_partkey").alias("file_id"), F.col("p_type").alias("tablespace_name"),
                               fname.alias("file_name"), (F.col("p_size").cast("long") * mb).alias("maxbytes")),
        "datafile_view": p.select(F.when(F.col("p_size") % 5 != 0, fname).otherwise(F.concat(F.lit("/old"), fname)).alias("name")),
        "free_space": li.select(F.col("l_partkey").alias("file_id"),
                                (F.col("l_quantity") * 1024).cast("long").alias("bytes")),
        "temp_files": s.select(F.col("s_suppkey").alias("file_id"),
                               _pick(F.col("s_nationkey"), TEMP_TABLESPACES).alias("tablespace_name"),
                               ((F.col("s_suppkey") % 7 + 1) * mb).alias("maxbytes")),
        "temp_header": li.select(F.col("l_suppkey").alias("file_id")),
        "tempfile_view": s.select(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey")).otherwise(-1 - F.col("s_suppkey")).alias("file_no")),
    }


def event_privileges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events -> users, package grants and role grants, one of each per event: UTL_RECOMP for a
    purchase with k = 7 and DBA for a signup with k < 10, else a package or role of another name."""
    ev = read_table(spark, d, "events")
    k = event_k()
    users = ev.select("user_id").distinct()
    tab = ev.select(
        "user_id", F.when((F.col("event_type") == "purchase") & (k == 7), F.lit("UTL_RECOMP")).otherwise(F.concat(F.lit("PKG"), k)).alias("table_name"),
        F.lit("EXECUTE").alias("privilege"))
    role = ev.select(
        "user_id", F.when((F.col("event_type") == "signup") & (k < 10), F.lit("DBA")).otherwise(F.concat(F.lit("ROLE"), k)).alias("granted_role"))
    return users, tab, role


# ---------------------------------------------------------------------------
# Registry, rules, scripts, artifacts
# ---------------------------------------------------------------------------

def event_registry(spark: SparkSession, d: str, split_at: str) -> tuple[DataFrame, DataFrame]:
    """events -> version registry rows (before ``split_at``) and updates (from then on)."""
    ev = read_table(spark, d, "events")
    k = event_k()
    rows = ev.select(F.concat_ws(":", F.col("user_id"), F.col("event_type")).alias("cd_produto"),
                     F.concat_ws(".", F.col("event_type"), k).alias("ds_versao"),
                     F.col("ts").alias("dh_atualizacao"), "event_id")
    at = F.lit(split_at).cast("timestamp_ntz")
    return rows.where(F.col("dh_atualizacao") < at), rows.where(F.col("dh_atualizacao") >= at)


def event_devices(spark: SparkSession, d: str) -> DataFrame:
    """events -> devices of a node: node = user, device = event id, size = k, free KB = value * 1000."""
    ev = read_table(spark, d, "events")
    return ev.select(F.col("user_id").alias("node"), F.col("event_id").alias("device"),
                     event_k().cast("string").alias("kb_size"),
                     (F.col("value") * 1000).cast("long").cast("string").alias("kb_available"))


def turn_scripts(spark: SparkSession, d: str) -> DataFrame:
    """conversations -> audit scripts, one per turn: id ``<conv>-<turn>``.

    " the " and " de " become a "/" line, ". " an empty line; the rest stays.
    """
    c = read_table(spark, d, "conversations")
    t = F.regexp_replace(F.col("text"), " (the|de) ", "\n/\n")
    t = F.regexp_replace(t, "\\. ", "\n\n")
    return c.select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("script_id"), t.alias("text"))


def document_artifacts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """documents -> artifacts; labelled documents -> their published .md5 files.

    A label of quality 0 publishes the hash of a changed text (a corrupt download).
    """
    docs = read_table(spark, d, "documents")
    lab = read_table(spark, d, "labels")
    art = docs.select(F.col("doc_id").alias("name"), F.col("text").alias("content"))
    # Hashed before the join: no text travels.
    hashes = docs.select("doc_id", F.md5("text").alias("good"), F.md5(F.concat("text", F.lit("#"))).alias("bad"))
    published = F.when(F.col("quality") == 1, F.col("good")).otherwise(F.col("bad"))
    exp = hashes.join(lab, "doc_id").select(
        F.col("doc_id").alias("name"),
        F.concat(published, F.lit("\ndoc"), F.col("doc_id"), F.lit("\n")).alias("md5_text"))
    return art, exp


# ---------------------------------------------------------------------------
# Topology: nation x return flag = balancer, supplier = server entry, line = app
# ---------------------------------------------------------------------------

HOST_SUPPLIERS = 50  # server host = h<suppkey div 50>: about two entries per nation share a host


def topology_inputs(spark: SparkSession, d: str, since: str | None = None, until: str | None = None,
                    split_at: str | None = None, stored: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(balancers, servers, server_ports, apps) of one document built from lines.

    Balancer = (supplier nation name, return flag); server entry = supplier at
    position s_suppkey, host h<suppkey div 50>; its ports = line numbers of its open
    (status O) lines; app = line (product = brand, port = line number). Lines of
    parts of type PROMO carry the reports context. ``since`` / ``until`` select lines
    by ship date. ``split_at`` makes two documents instead: "new" (lines shipped
    from that date) and "old" (earlier lines), each with every supplier as a server.
    ``stored`` writes the joined lines as a table first: the topology reads balancers
    twice and apps once, and each would join all lines with suppliers and parts again.
    """
    li = read_table(spark, d, "lineitem")
    if since:
        li = li.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        li = li.where(F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz"))
    s = read_table(spark, d, "supplier")
    n = read_table(spark, d, "nation")
    p = read_table(spark, d, "part")
    sn = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name", "n_nationkey")
    lines = li.join(sn, li.l_suppkey == sn.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    if stored:
        lines = materialize_table(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
                                               "l_shipdate", "n_name", "n_nationkey", "p_brand", "p_type"))
    if split_at:
        doc = F.when(F.col("l_shipdate") >= F.lit(split_at).cast("timestamp_ntz"), F.lit("new")) \
            .otherwise(F.lit("old")).alias("msg_id")
        server_doc = F.explode(F.array(F.lit("new"), F.lit("old"))).alias("msg_id")
    else:
        doc = server_doc = F.lit("topo").alias("msg_id")
    balancers = lines.select(doc, F.col("n_name").alias("balancer_host"),
                             F.col("l_returnflag").alias("balancer_port"),
                             (F.col("n_nationkey") * 10 + F.when(F.col("l_returnflag") == "A", 0)
                              .when(F.col("l_returnflag") == "N", 1).otherwise(2)).alias("bal_pos")).distinct()
    servers = s.select(server_doc, F.col("s_suppkey").alias("srv_pos"),
                       F.concat(F.lit("h"), F.expr(f"s_suppkey div {HOST_SUPPLIERS}")).alias("server_host"))
    ports = li.where(F.col("l_linestatus") == "O").select(
        doc, F.col("l_suppkey").alias("srv_pos"), F.col("l_linenumber").cast("string").alias("port")).distinct()
    apps = lines.select(
        doc, F.col("l_suppkey").alias("srv_pos"), "l_orderkey", "l_linenumber", "l_partkey",
        F.col("p_brand").alias("productname"),
        F.when(F.col("p_type") == "PROMO", F.lit("soul-product-reports")).otherwise(F.lit("soul-product-forms"))
        .alias("context"),
        F.lit("forms").alias("type"), F.col("l_linenumber").cast("string").alias("port"),
        F.col("n_name").alias("balancer_host"), F.col("l_returnflag").alias("balancer_port"))
    return balancers, servers, ports, apps


def client_agents(spark: SparkSession, d: str) -> DataFrame:
    """customer -> installed agents: version v<custkey % 3>."""
    c = read_table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("client_id"),
                    F.concat(F.lit("v"), F.col("c_custkey") % 3).alias("agent_version"))


def order_nodes(spark: SparkSession, d: str) -> DataFrame:
    """orders -> nodes with Ruby-hash attributes: one device per line, in line order.

    Linux nodes: device /dev/l<line>_<part>, size = quantity, free KB = price. Orders of
    0 modulo 3 are Windows: device letter by line number (line 1 = C:), home drive D: for
    even order keys. By order key modulo 10: 3 garbage, 5 NULL, 7 sizes that are no numbers.
    """
    o = read_table(spark, d, "orders")
    li = read_table(spark, d, "lineitem").join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    windows, key = F.col("l_orderkey") % 3 == 0, F.col("l_orderkey")
    device = F.when(windows, F.concat(F.char(F.col("l_linenumber") + 66), F.lit(":"))).otherwise(
        F.concat(F.lit("/dev/l"), F.col("l_linenumber"), F.lit("_"), F.col("l_partkey")))
    size = F.concat(F.col("l_quantity").cast("long"), F.when(key % 10 == 7, F.lit("kB")).otherwise(F.lit("")))
    text = F.concat(F.lit('"'), device, F.lit('"=>{"kb_size"=>"'), size, F.lit('", "kb_available"=>"'),
                    F.col("l_extendedprice").cast("long"), F.lit('"}'))
    # The lines of one order; a device that repeats keeps its last line.
    lines = li.groupBy("l_orderkey", device.alias("device")).agg(
        F.max(F.struct(*LINE_ORDER, text.alias("t"))).alias("m"))
    per = lines.groupBy(key.alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("device", "m.t"))).alias("items"))
    home = F.when(F.col("o_orderkey") % 2 == 0, F.lit(', "mvHome"=>"D:/mv"')).otherwise(F.lit(', "mvHome"=>nil'))
    attributes = F.concat(F.lit("{"), F.array_join(F.transform("items", lambda x: x["t"]), ", "), home, F.lit("}"))
    rest = F.col("o_orderkey") % 10
    attributes = F.when(rest == 3, F.lit("no hash")).when(rest == 5, F.lit(None).cast("string")).otherwise(attributes)
    return per.select(F.col("o_orderkey").alias("server_host"),
                      F.when(F.col("o_orderkey") % 3 == 0, F.lit("WINDOWS")).otherwise(F.lit("LINUX")).alias("server_type"),
                      attributes.alias("attributes"))


def document_scripts(spark: SparkSession, d: str) -> DataFrame:
    """documents -> audit scripts, whole texts, one row each (no grouping).

    Per line, in place: a line that is one word and a period (for example "Of.")
    becomes "/", a line that ends with "!" becomes empty; other lines stay.
    """
    docs = read_table(spark, d, "documents")
    t = F.regexp_replace(F.col("text"), "(?md)^[^ \\n]+\\.$", "/")
    t = F.regexp_replace(t, "(?md)^[^\\n]*!$", "")
    return docs.select(F.col("doc_id").alias("script_id"), t.alias("text"))


# ---------------------------------------------------------------------------
# Installation messages: one per order
# ---------------------------------------------------------------------------

# Plan of every stand-in document: two chef phases and an agent phase. Phase ids are
# text, so "10" runs before "2".
STANDIN_PLAN = [
    ("2", "chef", "deploy.started", "deploy.done", "deploy.failed"),
    ("10", "chef", "lines.started", "lines.done", "lines.failed"),
    ("3", "agent", "agent.started", "agent.done", "agent.failed"),
]
STANDIN_DEPLOY_RECIPE = "recipe[app::deploy]"


def order_servers(spark: SparkSession, d: str) -> DataFrame:
    """l_orderkey, servers (their lines in order), orders: the lines of each order, brought together once.

    Narrow rows travel, by order; servers and orders are put together where they arrive. Written as
    a table, as messages and outcomes both read it. ``orders`` holds the rows of that key (null without one).
    """
    li = read_table(spark, d, "lineitem").where(F.col("l_orderkey").isNotNull()).select("l_orderkey", *LINE_ORDER, "l_returnflag")
    p = read_table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    s = read_table(spark, d, "supplier")
    n = read_table(spark, d, "nation")
    sn = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "s_name", "n_name")
    lines = li.join(p, li.l_partkey == p.p_partkey).join(sn, li.l_suppkey == sn.s_suppkey)
    product = F.when((F.col("l_orderkey") % 17 == 3) & (F.col("l_linenumber") == 1), F.lit("SOULMV-H5")) \
        .when((F.col("l_orderkey") % 17 == 7) & (F.col("l_linenumber") == 1), F.lit("CLASRISCO")).otherwise(F.col("p_brand"))
    flat = lines.select("l_orderkey", *LINE_ORDER, product.alias("productname"), "p_name", "n_name", F.col("l_returnflag").alias("flag"),
                        "s_name").repartition("l_orderkey")
    item = F.struct(*[c for c in LINE_ORDER if c != "l_suppkey"], "productname", "p_name", "n_name", "flag")
    kept = ["l_linenumber", "l_partkey", "productname", "p_name", "n_name", "flag"]
    per_server = flat.groupBy("l_orderkey", "l_suppkey", "s_name").agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        "l_orderkey", F.struct("l_suppkey", "s_name", F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in kept])).alias("items")).alias("srv"))
    docs = per_server.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("srv")).alias("servers"))
    o = read_table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(
        F.collect_list(F.struct("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")).alias("orders"))
    return materialize_table(docs.join(o, "l_orderkey", "left"))


def order_installations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """orders + lines -> installation messages (JSON bodies) and their step outcomes.

    An order is one message. Its server entries are the suppliers of its lines (in
    supplier order); a server's apps are its lines (brand = product, line number =
    port, supplier nation and return flag = balancer); its run list is the deploy
    recipe (phase "2") and one recipe per line (phase "10"). A line with return
    flag R fails its recipe. A document is assembled from the lines of one order.

    By order key: 3 modulo 11 has a body that breaks off, 5 modulo 13 no outcomes of its
    lines, and in its first line 3 modulo 17 names a product group and 7 modulo 17 a
    group without that variant. Every document asks for an agent version (0 modulo 4:
    one that no client has), 0 modulo 19 for a rule that does not exist.
    """
    orders = order_servers(spark, d)
    line = F.col("l_orderkey")

    def app(server: F.Column, x: F.Column) -> F.Column:
        no_variant = (line % 17 == 7) & (x["l_linenumber"] == 1)
        return F.struct(
            x["productname"].alias("productname"), F.lit("g").alias("group"), F.lit(None).cast("string").alias("context"),
            F.when(no_variant, F.lit("reports")).otherwise(F.lit("web")).alias("type"), x["p_name"].alias("version"),
            x["l_partkey"].cast("string").alias("itemVersion"), x["l_linenumber"].cast("string").alias("port"),
            server["l_suppkey"].cast("string").alias("serverId"), x["n_name"].alias("balancer_host"),
            x["flag"].alias("balancer_port"), F.lit("i").alias("serverInstance"))

    def recipe(x: F.Column) -> F.Column:
        return F.concat(F.lit("recipe[line::"), x["l_linenumber"], F.lit("_"), x["l_partkey"], F.lit("]"))

    def server(s: F.Column) -> F.Column:
        return F.struct(
            F.struct(s["s_name"].alias("serverHost"), F.lit("deploy").alias("serverUser"),
                     F.lit("secret").alias("serverPassword"), F.lit("linux").alias("serverType"),
                     F.lit("prod").alias("environment"), F.lit("u").alias("urlbase")).alias("soulmvlinux"),
            F.struct(F.array_distinct(F.transform(s["items"], lambda x: x["l_linenumber"].cast("string"))).alias("port"))
            .alias("tomcatinstance"),
            F.transform(s["items"], lambda x: app(s, x)).alias("app_list"),
            F.array(F.struct(F.lit("2").alias("id"), F.array(F.lit(STANDIN_DEPLOY_RECIPE)).alias("recipes")),
                    F.struct(F.lit("10").alias("id"), F.transform(s["items"], recipe).alias("recipes")))
            .alias("run_list"))

    balancers = F.array_distinct(F.flatten(F.transform("servers", lambda s: F.transform(
        s["items"], lambda x: F.struct(x["n_name"].alias("host"), x["flag"].alias("port"))))))
    plan = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("type"), F.lit("0").alias("initialProgress"),
                              F.lit("100").alias("finalProgress"), F.lit(si).alias("statusInitial"),
                              F.lit(sc).alias("statusComplete"), F.lit(se).alias("statusError"),
                              F.lit(f"phase {i}").alias("initialDescription"),
                              F.lit(f"phase {i} done").alias("finalDescription"))
                     for i, t, si, sc, se in STANDIN_PLAN])
    key = F.col("o_orderkey")

    def rule(name: str, metric: F.Column) -> F.Column:
        return F.struct(F.lit(name).alias("name"), metric.alias("metric"))

    version = F.when(key % 4 == 0, F.lit("v9")).otherwise(F.concat(F.lit("v"), F.col("o_custkey") % 3))
    asked = F.filter(F.array(rule("CHECK_AGENT_VERSION", version),
                             F.when(key % 19 == 0, rule("CHECK_MOON", F.lit("full")))), lambda r: r.isNotNull())
    body = F.to_json(F.struct(F.transform("servers", server).alias("list_server"),
                              F.array_sort(balancers).alias("listBalancer"), plan.alias("executionPlan"),
                              asked.alias("validations")))
    body = F.substring(body, F.lit(1), F.when(key % 11 == 3, F.length(body) - 9).otherwise(F.lit(2**31 - 1)))
    msgs = orders.select("l_orderkey", "servers", F.explode("orders").alias("o")).select(
        "l_orderkey", "servers", F.col("l_orderkey").alias("o_orderkey"), "o.*").select(
        F.col("o_orderkey").cast("string").alias("msg_id"), F.col("o_custkey").cast("string").alias("client_id"),
        F.lit("Prod").alias("environment"), F.col("o_orderpriority").alias("execution_plan"),
        F.when(F.col("o_orderstatus") == "P", F.lit("download")).otherwise(F.lit("install")).alias("command"),
        F.lit("installation").alias("type_message"), F.col("o_orderdate").alias("arrival_ts"), body.alias("body"))
    # Outcomes: every recipe exits 0 except a line with return flag R; some orders report none for their lines.
    srv_pos = orders.select(F.col("l_orderkey").cast("string").alias("msg_id"), F.transform("servers", lambda s: s["l_suppkey"]).alias("sups"),
                            F.explode("servers").alias("s"))
    steps = srv_pos.select("msg_id", (F.array_position("sups", F.col("s.l_suppkey")) - 1).cast("int").alias("srv_pos"),
                           F.posexplode("s.items").alias("rec_pos", "it")).select("msg_id", "srv_pos", "rec_pos", F.col("it.flag").alias("flag"))
    reported = F.col("msg_id").cast("long") % 13 != 5
    line_out = steps.where(reported).select("msg_id", F.lit("10").alias("phase_id"), "srv_pos", F.lit(1).alias("visit_pos"),
                            F.lit(1).alias("entry_pos"), F.col("rec_pos").cast("int").alias("rec_pos"),
                            F.when(F.col("flag") == "R", 1).otherwise(0).alias("exit_status"))
    # One row per place, in the task that holds the order.
    deployed = orders.select(F.col("l_orderkey").cast("string").alias("msg_id"), F.explode(F.array_distinct(F.transform(
        "servers", lambda s: s["l_suppkey"]))).alias("_sup"), F.transform("servers", lambda s: s["l_suppkey"]).alias("sups"))
    deploy_out = deployed.select("msg_id", (F.array_position("sups", F.col("_sup")) - 1).cast("int").alias("srv_pos")).select(
        "msg_id", F.lit("2").alias("phase_id"), "srv_pos", F.lit(0).alias("visit_pos"), F.lit(0).alias("entry_pos"),
        F.lit(0).alias("rec_pos"), F.lit(0).alias("exit_status"))
    return msgs, line_out.unionByName(deploy_out)


# ---------------------------------------------------------------------------
# Script packages: documents in zip files (doc_id modulo PACKAGES names the package)
# ---------------------------------------------------------------------------

PACKAGES = 40


def document_packages(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """Writes the documents' texts as zip files under ``folder``; returns the package table.

    Package p<doc_id % 40>.zip holds its documents in order of id as scripts of 0 to 24 (doc_id div 40
    modulo 25; a later one has the name of an earlier one) under its product's prefix, those of doc_id % 7 = 3 elsewhere.
    Package 13 breaks off.
    """
    docs = read_table(spark, d, "documents").where(F.col("doc_id").isNotNull())
    rows = docs.select(F.pmod("doc_id", F.lit(PACKAGES)).cast("int").alias("p"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def write(batches):
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        now, z, raw = None, None, None

        def close():
            z.close()
            raw.close()
            if now == 13:
                with system.open_input_file(f"{base}/_p{now}.zip") as f:
                    head = f.read(f.size() // 2)
                with system.open_output_stream(f"{base}/_p{now}.zip") as f:
                    f.write(head)
            system.move(f"{base}/_p{now}.zip", f"{base}/p{now}.zip")
            return now

        done = []
        for b in batches:
            for p, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("p", "doc_id", "text"))):
                if p != now:
                    if z is not None:
                        done.append(close())
                    now, raw = p, system.open_output_stream(f"{base}/_p{p}.zip")
                    z = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                name = f"{doc_id // PACKAGES % 25}.sql"
                info = zipfile.ZipInfo(f"products/prod{p % 3}/database/{'post' if doc_id % 7 == 3 else 'pre'}/{name}")
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, text.encode())
        if z is not None:
            done.append(close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["p"])

    written = rows.repartition(PACKAGES, "p").sortWithinPartitions("p", "doc_id").mapInArrow(write, "p int")
    written.write.format("noop").mode("overwrite").save()
    return spark.range(PACKAGES).select(
        F.lit("m").alias("msg_id"), F.concat(F.lit("p"), "id", F.lit(".zip")).alias("filename"), F.concat(F.lit("prod"), F.col("id") % 3).alias("productName"),
        F.col("id").cast("string").alias("scriptId"), F.lit("1").alias("version"))
