"""Run outcomes: fail-stop prefix, outcome carry-forward, registry replacement, log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import fill
from .keyed import first_by
from .scan import last_non_null, next_value

STEP_ORDER = ("phase_id", "phase_pos", "visit_pos", "entry_pos", "rec_pos")


def _order_struct(order: Sequence[str | Column]) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)])


def fail_stop(step_rows: DataFrame, keys: Sequence[str] = ("msg_id",),
              order: Sequence[str | Column] = STEP_ORDER, exit_col: str = "exit_status") -> DataFrame:
    """Steps run in order; after the first non-zero exit nothing else runs.

    Keeps every step up to and including the first failing one of each message.
    Phase ids are text and sort as text. The first failure per message is a
    partial aggregate (``min`` of the order struct), joined back on the message
    key: no task ever holds a whole message, however hot.
    """
    keys = list(keys)
    pos = _order_struct(order)
    failed = F.coalesce(F.col(exit_col) != 0, F.lit(False))
    first_fail = (step_rows.where(failed).groupBy(*keys)
                  .agg(F.min(pos).alias("_first_fail")))
    joined = step_rows.join(first_fail, keys, "left")
    keep = F.col("_first_fail").isNull() | (pos <= F.col("_first_fail"))
    return (joined.where(keep)
            .withColumn("failed_here", failed)
            .drop("_first_fail"))


def phase_response(step_rows: DataFrame, keys: Sequence[str] = ("msg_id", "phase_id"),
                   order: Sequence[str | Column] = ("visit_pos", "entry_pos", "rec_pos"),
                   exit_col: str = "exit_status") -> DataFrame:
    """The response of a phase: its last executed step (for several servers the last counts)."""
    return first_by(step_rows.where(F.col(exit_col).isNotNull()), list(keys), list(order), last=True)


def phase_outcome(phase_rows: DataFrame, keys: Sequence[str] = ("msg_id",),
                  order: Sequence[str | Column] = ("phase_id", "phase_pos"),
                  exit_col: str = "exit_status", status_error: str | Column = "statusError",
                  status_complete: str | Column = "statusComplete", chunked: bool = True) -> DataFrame:
    """A phase that ran nothing reuses the previous phase's response.

    ``exit_col`` NULL = nothing ran. ``effective_exit`` = the last non-NULL exit up
    to this phase; with no earlier value the row gets ``_error`` (the agent fails
    there). ``chunked`` (default) runs the scan over range chunks
    (``scan.last_non_null``), so one message with very many phases is spread over
    many tasks; ``chunked=False`` is the single window per message.
    """
    if chunked:
        out = last_non_null(phase_rows, keys, order, exit_col, "effective_exit")
    else:
        w = (Window.partitionBy(*keys).orderBy(*[F.col(c) if isinstance(c, str) else c for c in order])
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = phase_rows.withColumn("effective_exit", F.last(F.col(exit_col), ignorenulls=True).over(w))
    return phase_status(out, exit_col, status_error, status_complete)


def phase_status(out: DataFrame, exit_col: str = "exit_status", status_error: str | Column = "statusError",
                 status_complete: str | Column = "statusComplete") -> DataFrame:
    """The status of phases whose ``effective_exit`` is known, and where it comes from."""
    se = F.col(status_error) if isinstance(status_error, str) else status_error
    sc = F.col(status_complete) if isinstance(status_complete, str) else status_complete
    return (out
            .withColumn("exit_source", F.when(F.col(exit_col).isNotNull(), F.lit("own"))
                        .when(F.col("effective_exit").isNotNull(), F.lit("carried"))
                        .otherwise(F.lit("none")))
            .withColumn("phase_status", F.when(F.col("effective_exit").isNull(), F.lit(None).cast("string"))
                        .when(F.col("effective_exit") != 0, se).otherwise(sc))
            .withColumn("_error", F.when(F.col("effective_exit").isNull(),
                                         F.lit("no earlier response to reuse"))))


def replace_by_key(registry: DataFrame, updates: DataFrame, key: Sequence[str],
                   update_order: Sequence[str | Column] | None = None) -> DataFrame:
    """Delete every registry row of an updated key, then insert the update.

    Among several updates of one key the last (by ``update_order``) wins, as a
    delete-then-insert loop leaves it. A NULL key deletes nothing (SQL equality).
    Written as one new generation, never in place.
    """
    key = list(key)
    if update_order is not None:
        updates = first_by(updates, key, list(update_order), last=True)
    kept = registry.join(updates.select(*key), key, "left_anti")
    return kept.withColumn("origin", F.lit("kept")).unionByName(
        updates.select(*registry.columns).withColumn("origin", F.lit("new")))


#: Each client's environment has a version registry of its own.
REGISTRY_KEY = ("client_id", "environment", "cd_produto")


def registry_updates(products: DataFrame, name_col: str = "name", version_col: str = "version",
                     updated_at: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """U1 rows: ``keep`` columns, cd_produto = name, ds_versao = name.version, dh_atualizacao.

    Over many clients ``keep`` names the message, client and environment, and
    ``replace_by_key`` takes ``REGISTRY_KEY``.
    """
    ts = F.lit(updated_at).cast("timestamp_ntz") if updated_at else F.localtimestamp()
    return products.select(
        *keep,
        F.col(name_col).alias("cd_produto"),
        fill("{name}.{version}", name=F.col(name_col), version=F.col(version_col)).alias("ds_versao"),
        ts.alias("dh_atualizacao"))


def log_events(df: DataFrame, level: str | Column, content: str | Column, client_col: str = "client_id",
               plan_col: str = "execution_plan", logged_at: str | None = None) -> DataFrame:
    """Log rows with the constant type and sync flag; content as JSON text.

    ``level`` is one of ``LOG_LEVELS`` or a column that holds them, so rows of several
    levels take one pass. The timestamp is a parameter so that reruns produce identical rows.
    """
    if isinstance(level, str):
        if level not in S.LOG_LEVELS:
            raise ValueError(f"unknown log level {level}")
        level = F.lit(level)
    c = F.col(content) if isinstance(content, str) else content
    dtype = df.select(c.alias("_c")).schema["_c"].dataType.typeName()
    text = c if dtype == "string" else F.to_json(c)
    ts = F.lit(logged_at).cast("timestamp_ntz") if logged_at else F.localtimestamp()
    return df.select(
        F.col(client_col).alias("cd_cliente"),
        F.lit(S.LOG_TYPE).alias("cd_tipo_log"),
        F.col(plan_col).alias("ds_identificador"),
        F.lit(S.LOG_SYNC_FLAG).alias("sn_sincronizado"),
        level.alias("ds_nivel"),
        ts.alias("dh_log"),
        text.alias("lo_conteudo"))


def run_durations(events: DataFrame, keys: Sequence[str] = ("msg_id",), kind_col: str = "kind", ts_col: str = "ts",
                  tie: Sequence[str] = ()) -> DataFrame:
    """How long runs took: each start with the end that directly follows it in its key's order of time.

    ``kind_col`` is "start" or "end" (other rows are left out); at one time a start stands before
    an end, then ``tie`` decides. A start that another start or nothing follows, and an end that no
    start stands before, are kept without their partner. ``elapsed`` is a day-time interval;
    hours, minutes and seconds are its fields, so whole days are lost in them. Rows of a hot key are
    spread over range chunks (``scan.next_value``).
    """
    keys = list(keys)
    seen = events.where(F.col(kind_col).isin("start", "end")).select(
        *keys, F.col(ts_col).alias("_ts"), (F.col(kind_col) == "end").alias("_end"), *tie)
    seen = seen.withColumn("_self", F.struct("_end", "_ts"))
    # The row after each one, and by the same scan backwards the row before: an end is matched if a start stands there.
    order = ["_ts", "_end", *tie]
    ahead = next_value(seen, keys, order, "_self", "_next")
    starts = ahead.where(~F.col("_end")).select(*keys, F.col("_ts").alias("start_ts"), F.when(F.col("_next._end"), F.col("_next._ts")).alias("end_ts"))
    # A row says of the one after it whether that is an end without a start; the first of a key has none before it.
    lone = ahead.where(F.col("_end") & F.col("_next._end")).select(*keys, F.lit(None).cast(seen.schema["_ts"].dataType).alias("start_ts"),
                                                                   F.col("_next._ts").alias("end_ts"))
    opening = seen.groupBy(*keys).agg(F.min(F.struct("_ts", "_end")).alias("_f")).where("_f._end").select(
        *keys, F.lit(None).cast(seen.schema["_ts"].dataType).alias("start_ts"), F.col("_f._ts").alias("end_ts"))
    runs = starts.unionByName(lone).unionByName(opening)
    elapsed = F.col("end_ts") - F.col("start_ts")
    return runs.withColumn("elapsed", elapsed).select(
        "*", F.expr("extract(HOUR FROM elapsed)").cast("int").alias("hours"), F.expr("extract(MINUTE FROM elapsed)").cast("int").alias("minutes"),
        F.expr("extract(SECOND FROM elapsed)").cast("int").alias("seconds"))
