"""Validation rules (P9, J7, J8, A4, F2) and the roll-up verdict (A2).

The registry maps a rule name to its checker; ``run_rules`` runs the rules that messages
ask for and gives result rows of one shape, and ``validation_verdict`` rolls all results
of a message up to one verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.text import drive_of, fill, ruby_hash_to_json
from .keyed import explode_literal, first_by


# ---------------------------------------------------------------------------
# Agent version
# ---------------------------------------------------------------------------

def version_check(requests: DataFrame, agents: DataFrame, keys: Sequence[str] = ("client_id",),
                  metric_col: str = "metric", version_col: str = "agent_version") -> DataFrame:
    """Fail when the installed agent version differs from the required one (NULL-safe)."""
    keys = list(keys)
    j = requests.join(agents.select(*keys, version_col), keys, "left")
    passed = F.col(version_col).eqNullSafe(F.col(metric_col))
    return j.withColumn("passed", passed).withColumn("message", F.when(~passed, fill(
        S.MSG_AGENT_OLD, current=F.col(version_col), required=F.col(metric_col))))


# ---------------------------------------------------------------------------
# tablespaces
# ---------------------------------------------------------------------------

def tablespace_check(capacity: DataFrame, envs: DataFrame | None = None, keys: Sequence[str] = (),
                     rules: Sequence[tuple[str, int]] = tuple(S.TABLESPACE_RULES)) -> DataFrame:
    """Each rule tablespace is missing, undersized (NULL size counts as undersized) or ok.

    Rules are exploded onto each environment as literals (no cross join), then
    left-joined to the capacity rows of that environment.
    """
    keys = list(keys)
    spark = capacity.sparkSession
    if envs is None:
        if keys:
            envs = capacity.select(*keys).distinct()
        else:
            envs = spark.range(1).select()
    r = envs.select(*keys, explode_literal(
        [(name, mb, i) for i, (name, mb) in enumerate(rules)], ["tablespace_name", "required_mb", "rule_pos"])
        .alias("_r")).select(*keys, "_r.*")
    # A capacity row with a NULL value is present but undersized, so presence is its own flag.
    cap = capacity.select(*keys, "tablespace_name", "value", F.lit(True).alias("_present"))
    j = r.join(cap, keys + ["tablespace_name"], "left")
    status = (F.when(F.col("_present").isNull(), F.lit("missing"))
              .when(F.coalesce(F.col("value") < F.col("required_mb"), F.lit(True)), F.lit("undersized"))
              .otherwise(F.lit("ok")))
    return j.select(*keys, "rule_pos", "tablespace_name", "required_mb", "value", status.alias("status"))


def tablespace_messages(check: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Warning texts per environment, in rule order: "[name : mb, ...]" per status.

    A group holds one row per rule (three), so the list is bounded.
    """
    keys = list(keys)
    item = F.struct("rule_pos", F.concat(F.col("tablespace_name"), F.lit(" : "), F.col("required_mb")).alias("t"))

    def joined(st: str) -> Column:
        arr = F.array_sort(F.collect_list(F.when(F.col("status") == st, item)))
        return F.array_join(F.transform(arr, lambda x: x["t"]), ", ")

    out = check.groupBy(*keys).agg(joined("missing").alias("not_found"), joined("undersized").alias("wrong"))
    return (out.withColumn("not_found_message", F.when(F.col("not_found") != "", fill(
                S.MSG_TABLESPACE_MISSING, items=F.col("not_found"))))
            .withColumn("wrong_message", F.when(F.col("wrong") != "", fill(
                S.MSG_TABLESPACE_WRONG, items=F.col("wrong")))))


# ---------------------------------------------------------------------------
# Privileges of the install user
# ---------------------------------------------------------------------------

def privilege_gap(users: DataFrame, privileges: DataFrame, keys: Sequence[str],
                  rules: Sequence[tuple[str, str]] = tuple(S.PRIVILEGE_RULES),
                  user_col: str | None = None) -> DataFrame:
    """Required (kind, value) rules without any privilege row of that kind.

    ``reported`` marks the first missing rule per user, which is the one the agent
    reports before it stops. A user group holds at most ``len(rules)`` rows.
    """
    keys = list(keys)
    extra = [user_col] if user_col and user_col not in keys else []
    req = users.select(*keys, *extra, explode_literal(
        [(k, v, i) for i, (k, v) in enumerate(rules)], ["NAME", "value", "rule_pos"]).alias("_r")) \
        .select(*keys, *extra, "_r.*")
    have = privileges.select(*keys, "NAME").distinct()
    missing = req.join(have, keys + ["NAME"], "left_anti")
    w = Window.partitionBy(*keys)
    user = F.col(user_col) if user_col else F.lit(None).cast("string")
    rule = dict(rules)
    message = F.when(F.col("NAME") == "PACKAGE", fill(S.MSG_NO_PACKAGE, user=user, package=F.lit(rule["PACKAGE"]))) \
        .otherwise(fill(S.MSG_NO_ROLE, user=user, role=F.col("value")))
    return missing.withColumn("reported", F.col("rule_pos") == F.min("rule_pos").over(w)) \
        .withColumn("message", message)


# ---------------------------------------------------------------------------
# A4 / F2: disk space
# ---------------------------------------------------------------------------

DEVICE_SCHEMA = T.StructType([T.StructField("kb_size", T.StringType()),
                              T.StructField("kb_available", T.StringType())])


def parse_filesystem(nodes: DataFrame, attr_col: str = "attributes", keys: Sequence[str] = ("server_host",)) \
        -> DataFrame:
    """F2 parse: Ruby-hash node attributes -> one row per (node, device).

    A node whose attributes are NULL, unreadable or empty keeps one row without a device.
    """
    keys = list(keys)
    # Values are devices (objects) or plain attributes such as mvHome: read every
    # value as text first, then each one as a device; non-devices get NULL sizes.
    m = F.from_json(ruby_hash_to_json(attr_col), T.MapType(T.StringType(), T.StringType()))
    out = nodes.select(*keys, *[c for c in nodes.columns if c not in keys and c != attr_col],
                       F.explode_outer(m).alias("device", "raw"))
    fs = F.from_json(F.col("raw"), DEVICE_SCHEMA)
    return out.withColumn("fs", fs).select(
        *[c for c in out.columns if c != "raw"], F.col("fs.kb_size").alias("kb_size"),
        F.col("fs.kb_available").alias("kb_available"))


def home_drive(nodes: DataFrame, attr_col: str = "attributes") -> Column:
    """Windows home drive from the ``mvHome`` attribute (default C:)."""
    home = F.get_json_object(ruby_hash_to_json(attr_col), "$.mvHome")
    return drive_of(home, S.DEFAULT_WINDOWS_DRIVE)


def largest_partition(devices: DataFrame, keys: Sequence[str], device_col: str = "device",
                      size_col: str = "kb_size") -> DataFrame:
    """A4: among devices with a readable size, the one with the greatest size (ties: smallest name).

    An aggregate (``first_by``), so a node with very many devices is combined map-side.
    """
    sized = devices.where(F.col(size_col).isNotNull() & (F.col(size_col).cast("string") != "")) \
        .withColumn("_neg", -F.col(size_col).try_cast("long")).where(F.col("_neg").isNotNull())
    return first_by(sized, list(keys), ["_neg", device_col]).drop("_neg")


def disk_check(devices: DataFrame, keys: Sequence[str], metric_mb: int | Column,
               type_col: str | None = None, drive_col: str | None = None,
               device_col: str = "device", avail_col: str = "kb_available") -> DataFrame:
    """free MB (kb_available / 1000, truncated) of the chosen device must reach the metric.

    Linux picks the largest partition (A4); Windows picks the device of the home
    drive. Every node is judged (the agent stops at the first failing one): a node
    without a usable device, with sizes that are no numbers, or without its home drive
    fails with a cause.
    """
    keys = list(keys)
    metric = F.lit(metric_mb) if isinstance(metric_mb, int) else metric_mb
    if isinstance(metric_mb, str):
        metric = F.col(metric_mb)
    rest = [c for c in devices.columns if c not in (*keys, device_col, avail_col, "kb_size")]
    # One row per node whatever its devices; the chosen device is joined to it.
    nodes = first_by(devices.select(*keys, *rest), keys, rest) if rest else devices.select(*keys).distinct()
    usable = devices.where(F.col(device_col).isNotNull()).select(*keys, device_col, "kb_size", avail_col,
                                                                 *([type_col, drive_col] if type_col else []))
    if type_col is None:
        chosen = largest_partition(usable, keys, device_col)
        err = F.when(F.col(device_col).isNull(), F.lit("no usable device"))
    else:
        linux = F.col(type_col).eqNullSafe(S.MACHINE_LINUX)
        lin = largest_partition(usable.where(linux), keys, device_col)
        win = usable.where(~linux & (F.col(device_col) == F.col(drive_col)))
        chosen = lin.unionByName(first_by(win, keys, [device_col])).drop(type_col, drive_col)
        err = F.when(F.col(device_col).isNull() & ~linux, F.concat(F.lit("home drive not found: "), F.col(drive_col))) \
            .when(F.col(device_col).isNull(), F.lit("no usable device"))
    chosen = nodes.join(chosen.select(*keys, device_col, "kb_size", avail_col), keys, "left")
    free = (F.col(avail_col).try_cast("long") / 1000).cast("long")
    err = F.coalesce(err, F.when(F.col("free_mb").isNull(), F.lit("free space is no number")))
    out = (chosen.withColumn("free_mb", free)
           .withColumn("passed", F.coalesce(F.col("free_mb") >= metric, F.lit(False)))
           .withColumn("_error", err))
    host = F.col(keys[-1])
    home = F.col("_error").startswith("home drive")
    cause = F.when(home, fill(S.MSG_HOME_MISSING, drive=F.col(drive_col) if drive_col else F.lit(None))) \
        .when(F.col("_error").isNotNull(), F.col("_error")) \
        .otherwise(fill(S.MSG_DISK_LOW, free=F.col("free_mb"), metric=metric))
    return out.withColumn("message", F.when(~F.col("passed"), fill(S.MSG_DISK_FAILED, host=host, cause=cause)))


# ---------------------------------------------------------------------------
# A2: roll-up
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Observations:
    """What was observed of the clients' environments; a table that is None was not observed."""

    agents: DataFrame | None = None       # client_id, agent_version
    nodes: DataFrame | None = None        # msg_id, server_host, server_type, attributes
    connections: DataFrame | None = None  # client_id, environment, connected
    capacity: DataFrame | None = None     # client_id, environment, tablespace_name, value
    privileges: DataFrame | None = None   # client_id, environment, NAME


def _agent_version(req: DataFrame, seen: Observations) -> DataFrame:
    return version_check(req, seen.agents).select("msg_id", "rule_pos", "passed", "message")


def _servers_disk_space(req: DataFrame, seen: Observations) -> DataFrame:
    """Every server of the message must pass; the message of its first failing host is reported."""
    nodes = seen.nodes.withColumn("drive", home_drive(seen.nodes))
    nodes = nodes.withColumn("server_type", F.coalesce("server_type", F.lit(S.MACHINE_WINDOWS)))
    devices = parse_filesystem(nodes, keys=("msg_id", "server_host")).join(
        req.select("msg_id", "rule_pos", F.col("metric").try_cast("long").alias("metric_mb")), "msg_id")
    judged = disk_check(devices, ["msg_id", "rule_pos", "server_host"], "metric_mb", "server_type", "drive")
    per = judged.groupBy("msg_id", "rule_pos").agg(
        F.bool_and("passed").alias("passed"),
        F.min(F.when(~F.col("passed"), F.struct("server_host", "message"))).alias("_m"))
    return per.select("msg_id", "rule_pos", "passed", F.col("_m.message").alias("message"))


def _database_connection(req: DataFrame, seen: Observations) -> DataFrame:
    up = seen.connections.groupBy("client_id", "environment").agg(F.bool_and("connected").alias("passed"))
    j = req.join(up, ["client_id", "environment"], "left")
    passed = F.coalesce("passed", F.lit(False))
    return j.select("msg_id", "rule_pos", passed.alias("passed"),
                    F.when(~passed, F.lit("no database connection")).alias("message"))


def _database_tablespace(req: DataFrame, seen: Observations) -> DataFrame:
    """Missing and undersized tablespaces are warned of; the rule never fails."""
    keys = ["client_id", "environment"]
    check = tablespace_check(seen.capacity, req.select(*keys).distinct(), keys)
    texts = tablespace_messages(check, keys)
    j = req.join(texts, keys, "left")
    return j.select("msg_id", "rule_pos", F.lit(True).alias("passed"),
                    F.nullif(F.concat_ws(" ", "not_found_message", "wrong_message"), F.lit("")).alias("message"))


def _database_user(req: DataFrame, seen: Observations) -> DataFrame:
    gap = privilege_gap(req.select("client_id", "environment").distinct(), seen.privileges, ["client_id", "environment"])
    first = gap.where("reported").select("client_id", "environment", F.col("message").alias("message"))
    j = req.join(first, ["client_id", "environment"], "left")
    return j.select("msg_id", "rule_pos", F.col("message").isNull().alias("passed"), "message")


#: Rule name -> its checker and the table that it needs.
RULE_REGISTRY: dict[str, tuple[Callable[[DataFrame, Observations], DataFrame], str]] = {
    "CHECK_AGENT_VERSION": (_agent_version, "agents"),
    "CHECK_SERVERS_DISK_SPACE": (_servers_disk_space, "nodes"),
    "CHECK_DATABASE_CONNECTION": (_database_connection, "connections"),
    "CHECK_DATABASE_TABLESPACE": (_database_tablespace, "capacity"),
    "CHECK_DATABASE_USER_MASTER": (_database_user, "privileges"),
}


def required_rules(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """The rules that each message asks for: msg_id, client_id, environment, rule_pos, rule, metric."""
    v = docs.select("msg_id", "client_id", "environment", F.posexplode(f"{doc_col}.validations").alias("rule_pos", "v"))
    return v.select("msg_id", "client_id", "environment", "rule_pos", F.col("v.name").alias("rule"),
                    F.col("v.metric").alias("metric"))


def run_rules(rules: DataFrame, seen: Observations) -> DataFrame:
    """Runs every required rule: one row each of msg_id, rule_pos, rule, passed, message.

    A rule whose table was not observed, or that finds no row to judge (a message
    without servers), fails with a message. An unknown name fails as well, and
    ``validation_verdict`` makes its message an error.
    """
    out = None
    for name, (check, table) in RULE_REGISTRY.items():
        if getattr(seen, table) is None:
            continue
        part = check(rules.where(F.col("rule") == name), seen).select("msg_id", "rule_pos", "passed", "message")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rules.select("msg_id", "rule_pos", "rule", F.lit(False).alias("passed"), F.lit("not observed").alias("message"))
    judged = out.withColumn("_judged", F.lit(True))
    j = rules.select("msg_id", "rule_pos", "rule").join(judged, ["msg_id", "rule_pos"], "left")
    return j.select("msg_id", "rule_pos", "rule", F.coalesce("passed", F.lit(False)).alias("passed"),
                    F.when(F.col("_judged").isNull(), F.lit("not observed")).otherwise(F.col("message")).alias("message"))


def validation_verdict(results: DataFrame, docs: DataFrame, keys: Sequence[str] = ("msg_id",),
                       passed_col: str = "passed", rule_col: str | None = "rule") -> DataFrame:
    """A2: a document passes when no rule failed; no rule at all passes.

    A rule name outside the known validation types makes the document an error row,
    as an unknown name stops the agent. ``bool_and`` is a partial aggregate.
    """
    keys = list(keys)
    unknown = (~F.coalesce(F.col(rule_col).isin(*S.VALIDATION_TYPES), F.lit(False))) if rule_col else F.lit(False)
    agg = results.groupBy(*keys).agg(
        F.bool_and(F.coalesce(F.col(passed_col), F.lit(False))).alias("_all"),
        F.count(F.lit(1)).alias("n_rules"),
        F.count(F.when(~F.coalesce(F.col(passed_col), F.lit(False)), 1)).alias("n_failed"),
        F.bool_or(F.coalesce(unknown, F.lit(False))).alias("_unknown"))
    j = docs.join(agg, keys, "left")
    return j.select(
        *docs.columns,
        F.coalesce(F.col("_all"), F.lit(True)).alias("verdict"),
        F.coalesce(F.col("n_rules"), F.lit(0)).alias("n_rules"),
        F.coalesce(F.col("n_failed"), F.lit(0)).alias("n_failed"),
        F.when(F.coalesce(F.col("_unknown"), F.lit(False)), F.lit("unknown validation rule")).alias("_error"))
