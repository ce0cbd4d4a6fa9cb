"""Installation documents: flatten, expand product groups, plan phases, status rows.

Documents arrive one per row (``msg_id``, ``doc``). Everything below works on
flat tables keyed by ``msg_id`` first; nesting happens only at a sink.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import codes
from ..functions.text import fill
from .keyed import first_by


def mask_secrets(df: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Drop password fields from a parsed body before anything is stored."""
    dtype = df.schema[doc_col].dataType
    names = {f.name for f in dtype.fields}
    doc = F.col(doc_col)
    drop_top = [n for n in S.SECRET_FIELDS if n in names]
    if drop_top:
        doc = doc.dropFields(*drop_top)
    if "list_server" in names:
        doc = doc.withField("list_server", F.transform(
            F.col(f"{doc_col}.list_server"),
            lambda s: s.withField("soulmvlinux", s["soulmvlinux"].dropFields("serverPassword"))))
    return df.withColumn(doc_col, F.when(F.col(doc_col).isNotNull(), doc))


# ---------------------------------------------------------------------------
# Flattening
# ---------------------------------------------------------------------------

def servers(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """One row per server entry, with its position in the document."""
    s = docs.select("msg_id", F.posexplode(f"{doc_col}.list_server").alias("srv_pos", "srv"))
    return s.select(
        "msg_id", "srv_pos",
        F.col("srv.soulmvlinux.serverHost").alias("server_host"),
        F.col("srv.soulmvlinux.serverUser").alias("server_user"),
        codes.machine_type(F.col("srv.soulmvlinux.serverType")).alias("server_type"),
        F.col("srv.soulmvlinux.environment").alias("environment"),
        F.col("srv.soulmvlinux.urlbase").alias("urlbase"),
        F.transform(F.col("srv.tomcatinstance.port"), lambda p: p.cast("string")).alias("ports"),
        F.col("srv.app_list").alias("app_list"),
        F.col("srv.run_list").alias("run_list"),
    )


def apps(srv: DataFrame) -> DataFrame:
    """One row per app of each server entry (order: server, then app)."""
    a = srv.select("msg_id", "srv_pos", "server_host", "environment",
                   F.posexplode("app_list").alias("app_pos", "app"))
    return a.select("msg_id", "srv_pos", "server_host", "environment", "app_pos", "app.*")


def run_entries(srv: DataFrame) -> DataFrame:
    """Run-list entries of each server entry: (msg_id, srv_pos, entry_pos, id, recipes)."""
    r = srv.select("msg_id", "srv_pos", "server_host", "server_type",
                   F.posexplode("run_list").alias("entry_pos", "entry"))
    return r.select("msg_id", "srv_pos", "server_host", "server_type", "entry_pos",
                    F.col("entry.id").alias("id"), F.col("entry.recipes").alias("recipes"))


def phases(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Plan actions of each document with their position; type normalised."""
    p = docs.select("msg_id", F.posexplode(f"{doc_col}.executionPlan").alias("plan_pos", "ph"))
    return p.select("msg_id", "plan_pos", "ph.*").withColumn("type", codes.phase_type("type"))


def phases_from_rows(rows: DataFrame, type_col: str = "type") -> DataFrame:
    """Plan actions already flat: only the phase type is normalised."""
    return rows.withColumn(type_col, codes.phase_type(type_col))


# ---------------------------------------------------------------------------
# Phase plan
# ---------------------------------------------------------------------------

def plan_phases(phase_rows: DataFrame, entries: DataFrame, keys: Sequence[str] = ("msg_id",),
                id_col: str = "id", type_col: str = "type", entry_id_col: str = "id") -> DataFrame:
    """Phases with the number of server visits; keep phases with a visit or of type AGENT.

    A server is visited once per matching run-list entry. The count is a partial
    aggregate of the entries first (one row per (keys, id) leaves each map task),
    then a left join to the phases, so a hot phase never gathers in one task.
    """
    keys = list(keys)
    per_id = (entries.where(F.col(entry_id_col).isNotNull())
              .groupBy(*[F.col(k) for k in keys], F.col(entry_id_col).alias("_pid"))
              .agg(F.count(F.lit(1)).alias("n_servers")))
    joined = phase_rows.join(
        per_id, [phase_rows[k].eqNullSafe(per_id[k]) for k in keys] + [phase_rows[id_col] == per_id["_pid"]],
        "left")
    out = joined.select(phase_rows["*"], F.coalesce(per_id["n_servers"], F.lit(0)).alias("n_servers"))
    return out.where((F.col("n_servers") > 0) | (F.col(type_col) == "AGENT"))


def phase_visits(phase_rows: DataFrame, entries: DataFrame, keys: Sequence[str] = ("msg_id",),
                 id_col: str = "id") -> DataFrame:
    """The flat (phase, server entry) visits behind ``plan_phases`` (one per matching entry)."""
    keys = list(keys)
    e = entries.withColumnRenamed(id_col, "_eid")
    cond = [phase_rows[k] == e[k] for k in keys] + [phase_rows[id_col] == e["_eid"]]
    out = phase_rows.join(e, cond, "inner")
    return out.select(phase_rows["*"], *[e[c] for c in e.columns if c not in keys and c != "_eid"])


def steps(visits: DataFrame, entries: DataFrame) -> DataFrame:
    """Each visit runs every matching entry of its server, recipe by recipe.

    ``visits``: (msg_id, phase_id, srv_pos, visit_pos and any phase columns); ``entries``
    from ``run_entries``. Output is the ordered step table that ``fail_stop`` reads. A
    visit of an entry without recipes is one row with a NULL recipe.
    """
    # Entries travel whole; their recipes become rows after the join.
    e = entries.select("msg_id", "srv_pos", F.col("entry_pos"), F.col("id").alias("phase_id"), "recipes")
    return (visits.join(e, ["msg_id", "srv_pos", "phase_id"], "left")
            .select("*", F.posexplode_outer("recipes").alias("rec_pos", "recipe")).drop("recipes")
            .withColumn("is_balancer", codes.is_balancer_recipe("recipe")))


# ---------------------------------------------------------------------------
# products
# ---------------------------------------------------------------------------

def first_products(app_rows: DataFrame, keys: Sequence[str] = ("msg_id",), name_col: str = "productname",
                   order: Sequence[str | Column] = ("srv_pos", "app_pos")) -> DataFrame:
    """First-wins distinct products by name, in server then app order.

    Runs on the unexpanded apps, as the agent does. Skew-safe: ``first_by`` is an
    aggregate with a map-side combine.
    """
    return first_by(app_rows, list(keys) + [name_col], list(order))


def expand_groups(app_rows: DataFrame, groups: Mapping[str, Sequence[str]], contexts: Mapping[str, str],
                  expandable: Sequence[str] = tuple(S.EXPANDABLE_PRODUCTS),
                  name_col: str = "productname", type_col: str = "type",
                  copy_cols: Sequence[str] = ("group", "version", "itemVersion", "port", "serverId",
                                              "balancer_host", "balancer_port", "serverInstance"),
                  ) -> DataFrame:
    """J1 + T6: apps named like a product group are replaced by the group's items.

    The lookup key is the name with "-" turned into "_", plus "_REPORTS" when the
    app type is "reports". An item gets type "forms", the context of its own key,
    and the listed fields of its group app; other fields are dropped. A group
    without that variant is kept as one row with ``_error`` set. ``groups`` (key -> items)
    and ``contexts`` (key -> context) are a few fixed rows; they stand in the plan as map
    literals, so the apps are neither joined nor shuffled. Apps keep their place; items
    carry ``item_pos``.
    """
    key = F.concat(F.translate(F.col(name_col), "-", "_"),
                   F.when(F.col(type_col) == S.REPORTS_TYPE, F.lit(S.REPORTS_SUFFIX)).otherwise(F.lit("")))
    is_group = F.coalesce(F.col(name_col).isin(*expandable), F.lit(False))
    flagged = app_rows.withColumn("_is_group", is_group).withColumn("_gkey", F.when(is_group, key))
    # One pass: a group app explodes into its items; any other app (and a group
    # without its variant) stays one row, with no item.
    items = _lookup({k: F.array(*map(F.lit, v)) for k, v in groups.items()}, F.col("_gkey"))
    looked = flagged.withColumn("_items", items)
    rows = looked.select("*", F.posexplode_outer(F.when(F.col("_is_group"), F.col("_items")))
                         .alias("item_pos", "_item"))
    rows = rows.withColumn("_ctx", _lookup({k: F.lit(v) for k, v in contexts.items()}, F.translate("_item", "-", "_")))
    item = F.col("_item").isNotNull()
    cols = app_rows.columns
    out = []
    for c in cols:
        if c == name_col:
            out.append(F.when(item, F.col("_item")).otherwise(F.col(c)).alias(c))
        elif c == type_col:
            out.append(F.when(item, F.lit(S.EXPANDED_TYPE)).otherwise(F.col(c)).alias(c))
        elif c == "context":
            out.append(F.when(item, F.col("_ctx")).otherwise(F.col(c)).alias(c))
        elif c in _app_fields() and c not in copy_cols:
            # Of the app's own fields only ``copy_cols`` are carried to its items.
            out.append(F.when(item, F.lit(None).cast(app_rows.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    if "context" not in cols:
        out.append(F.when(item, F.col("_ctx")).alias("context"))
    error = (F.when(F.col("_is_group") & F.col("_items").isNull(), F.concat(F.lit("no product group "), F.col("_gkey")))
             .when(item & F.col("_ctx").isNull(),
                   F.concat(F.lit("no product context "), F.translate(F.col("_item"), "-", "_"))))
    # An item without a context is an error in the agent (the lookup throws).
    return rows.select(*out, F.col("item_pos").cast("int").alias("item_pos"), error.alias("_error"))


def _lookup(table: Mapping[str, Column], key: Column) -> Column:
    """The value of ``key`` in a fixed table, NULL if it has none."""
    return F.element_at(F.create_map(*[c for k, v in table.items() for c in (F.lit(k), v)]), key)


def _app_fields() -> set[str]:
    return {f.name for f in S.APP_SCHEMA.fields}


# ---------------------------------------------------------------------------
# J5, J6, J9
# ---------------------------------------------------------------------------

def balancer_for_server(srv: DataFrame, topo: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """Balancers whose host equals the server host (install commands only).

    ``topo`` is the flat topology (msg_id, balancer_host, balancer_port, ...).
    """
    b = topo.select("msg_id", F.col("balancer_host").alias("server_host"), "balancer_port").distinct()
    out = srv.join(b, ["msg_id", "server_host"], "left")
    if commands is not None:
        out = out.join(commands.select("msg_id", "command"), "msg_id", "left").withColumn(
            "balancer_port", F.when(F.col("command").isin(*S.INSTALL_COMMANDS), F.col("balancer_port")))
    return out


def status_events(phase_rows: DataFrame, products: DataFrame, keys: Sequence[str] = ("msg_id",),
                  created_at: str | None = None) -> DataFrame:
    """Environment-item status rows, one per (phase, product), start and result.

    ``phase_rows``: keys, phase_id, statusInitial, statusComplete, statusError,
    initialProgress, finalProgress, initialDescription, finalDescription, exit_status,
    client_id, execution_plan. ``products``: keys, name, itemVersion, environment.
    An equi join on the message key: pairs are formed only within one message.
    The result row uses the error status when the phase exit is not 0.
    """
    keys = list(keys)
    pairs = phase_rows.join(products, keys, "inner")
    failed = F.coalesce(F.col("exit_status") != 0, F.lit(False))
    ts = F.lit(created_at).cast("timestamp_ntz") if created_at else F.localtimestamp()
    common = [*[F.col(k) for k in keys], "phase_id", F.col("itemVersion").alias("cd_item"),
              F.col("client_id").alias("cd_cliente"), F.col("environment").alias("cd_ambiente"),
              F.col("execution_plan").alias("cd_plano_execucao"), ts.alias("dh_criacao")]
    def row(kind: str, status: Column, progress: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("event_kind"), status.alias("cd_item_status"),
                        F.col(progress).alias("nr_progresso"), text.alias("ds_progresso"))

    start = row("start", F.col("statusInitial"), "initialProgress", F.col("initialDescription"))
    result = row("result", F.when(failed, F.col("statusError")).otherwise(F.col("statusComplete")), "finalProgress",
                 F.when(failed, F.concat(F.lit(S.ERROR_DESCRIPTION_PREFIX),
                                         F.coalesce(F.col("initialDescription"), F.lit("null"))))
                 .otherwise(F.col("finalDescription")))
    # Both rows leave one join.
    both = pairs.select(*common, F.explode(F.array(start, result)).alias("_e"))
    return both.select(*[c for c in both.columns if c != "_e"], "_e.*")


def server_status_events(visit_rows: DataFrame, app_rows: DataFrame) -> DataFrame:
    """J6 (servers): one row per app of a visited server; item = productname.version."""
    pairs = visit_rows.join(app_rows, ["msg_id", "srv_pos"], "inner")
    failed = F.coalesce(F.col("exit_status") != 0, F.lit(False))
    return pairs.select(
        "msg_id", "phase_id", "srv_pos",
        fill("{name}.{version}", name=F.col("productname"), version=F.col("version")).alias("cd_item"),
        F.when(failed, F.col("statusError")).otherwise(F.col("statusComplete")).alias("cd_item_status"),
        F.col("client_id").alias("cd_cliente"), F.col("environment").alias("cd_ambiente"),
        F.col("execution_plan").alias("cd_plano_execucao"), F.col("serverId").alias("cd_servidor"))


def script_index(scripts: DataFrame, keys: Sequence[str] = ("msg_id",), name_col: str = "name",
                 package_col: str = "package", pos_col: str = "pos") -> DataFrame:
    """Script name -> package; a later package (greater position) overwrites an earlier one."""
    cols = list(keys) + [name_col, package_col, pos_col]
    return first_by(scripts.select(*cols), list(keys) + [name_col], [pos_col], last=True)


def dimension_tables() -> tuple[dict[str, list[str]], dict[str, str]]:
    """The fixed product groups (key -> items) and contexts (key -> context)."""
    return dict(S.PRODUCT_GROUPS), dict(S.PRODUCT_CONTEXTS)
