"""Command messages: normalise, address filter, checksum gate, de-duplicate, route, parse.

All functions are stream-safe (no global sort, no non-time window) except
``dedup_messages`` in batch form; ``streaming.messages`` uses the watermark form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import codes
from .keyed import first_by
from .scan import last_non_null

DEDUP_KEYS = ["client_id", "message_id", "type_message"]


def normalize_codes(msgs: DataFrame, type_col: str = "type_message",
                    command_col: str | None = "command") -> DataFrame:
    """Message type upper-cased to a known name or UNKNOWN; command exact text or UNKNOWN."""
    out = msgs.withColumn(type_col, codes.message_type(type_col))
    if command_col and command_col in msgs.columns:
        out = out.withColumn(command_col, codes.command(command_col))
    return out


def address_filter(msgs: DataFrame, clients: DataFrame, client_col: str = "client_id") -> DataFrame:
    """Keep messages that carry a client id known to the client registry.

    A semi join; Spark broadcasts the registry only when its measured size is under
    the broadcast threshold (AQE re-checks it at run time), else it shuffles.
    """
    known = clients.select(F.col("client_id").alias("_cid")).where(F.col("_cid").isNotNull())
    return (msgs.where(F.col(client_col).isNotNull())
            .join(known, F.col(client_col) == F.col("_cid"), "left_semi"))


def checksum_gate(msgs: DataFrame, clients: DataFrame, client_col: str = "client_id",
                  type_col: str = "type_message", checksum_col: str = "checksum") -> DataFrame:
    """BOOTSTRAP and INSTALLATION need checksum = the client's stored hash (NULL = NULL).

    Other types pass. A client that the registry lists more than once (its owner keeps
    one row by ``replace_by_key``) counts once, with the least hash, so no message is
    multiplied.
    """
    reg = clients.groupBy(F.col("client_id").alias("_cid")).agg(F.min("env_hash").alias("_hash"))
    joined = msgs.join(reg, F.col(client_col) == F.col("_cid"), "inner")
    gated = F.col(type_col).isin(*S.CHECKSUM_TYPES)
    keep = (~gated) | F.col(checksum_col).eqNullSafe(F.col("_hash"))
    return joined.where(keep).drop("_cid", "_hash")


def accept_messages(msgs: DataFrame, clients: DataFrame, **cols) -> DataFrame:
    """P1 + P2 in one join with the registry (its hash is needed anyway)."""
    client_col = cols.get("client_col", "client_id")
    return checksum_gate(msgs.where(F.col(client_col).isNotNull()), clients, **cols)


def accept_messages_asof(msgs: DataFrame, changes: DataFrame, id_cols: Sequence[str] = ("msg_id",),
                         client_col: str = "client_id", type_col: str = "type_message", checksum_col: str = "checksum",
                         ts_col: str = "arrival_ts", change_order: Sequence[str] = ()) -> DataFrame:
    """P1 + P2 as of each message's time: the gate reads the hash that was stored when the message came.

    ``changes``: client_id, changed_ts, env_hash and the columns of ``change_order`` (which of
    several changes at one time is the last; after them the greatest hash). A client is known
    from its first change on; a change holds for messages of the same time. A hash that was
    set to NULL equals a NULL checksum. Messages without client id or time are left out, as are
    those of a client not known by then; changes without client or time count as none.

    Changes and messages are merged by (client, time) and the last hash is carried over
    range chunks (``scan.last_non_null``), so a client with a third of all messages is spread over many
    tasks. Only ids and gate columns take part; the messages are then kept by a semi join on
    ``id_cols``, which name each message.
    """
    tie = list(change_order)
    per_time = changes.where(F.col("client_id").isNotNull() & F.col("changed_ts").isNotNull()) \
        .groupBy("client_id", "changed_ts").agg(F.max(F.struct(*tie, "env_hash")).alias("_c"))
    none = [F.lit(None).cast(msgs.schema[c].dataType).alias(c) for c in id_cols]
    known = per_time.select(
        F.col("client_id").alias("_cid"), F.col("changed_ts").alias("_ts"), F.lit(0).alias("_kind"), *none,
        F.lit(None).cast("string").alias("_checksum"), F.lit(False).alias("_gated"), F.struct(F.col("_c.env_hash").alias("hash")).alias("_hash"))
    asked = msgs.where(F.col(client_col).isNotNull() & F.col(ts_col).isNotNull()).select(
        F.col(client_col).alias("_cid"), F.col(ts_col).alias("_ts"), F.lit(1).alias("_kind"), *id_cols, F.col(checksum_col).alias("_checksum"),
        F.col(type_col).isin(*S.CHECKSUM_TYPES).alias("_gated"), F.lit(None).cast(known.schema["_hash"].dataType).alias("_hash"))
    merged = last_non_null(known.unionByName(asked), ["_cid"], ["_ts", "_kind", *id_cols], "_hash", "_held")
    gated = F.coalesce(F.col("_gated"), F.lit(False))
    passed = merged.where((F.col("_kind") == 1) & F.col("_held").isNotNull()
                          & (~gated | F.col("_checksum").eqNullSafe(F.col("_held.hash")))).select(*id_cols)
    return msgs.where(F.col(client_col).isNotNull()).join(passed, list(id_cols), "left_semi")


def dedup_messages(msgs: DataFrame, keys: Sequence[str] = DEDUP_KEYS,
                   order: Sequence[str] = ("arrival_ts",)) -> DataFrame:
    """W2 (batch): the first message per (client, message id, type) by arrival.

    Declared difference: the agent keeps a count-bounded history (100, cut to 2),
    so very old repeats run again; a table has no such artefact and keeps the first.
    Aggregation-based, so a hot key is combined map-side.
    """
    return first_by(msgs, list(keys), list(order))


def dedup_history(msgs: DataFrame, keys: Sequence[str] = DEDUP_KEYS, order: Sequence[str] = ("arrival_ts", "msg_id"),
                  limit: int = 100, keep: int = 2, client_col: str = "client_id") -> DataFrame:
    """W2 as the agent has it: a client's history of headers is cut to the last ``keep`` when it reaches ``limit``.

    A copy is dropped while its header stands in the history, so very old repeats run again. What a
    client's message meets depends on all before it, so a client is one pass in order of
    arrival: rows are sorted within their task and streamed, with at most ``limit`` headers held,
    whatever the client's size. Only the key's hash and the order take part in that pass; the messages are kept by
    a semi join on ``order``, which names each message within its client.
    """
    import pyarrow as pa

    order = list(order)
    header = F.md5(F.to_json(F.struct(*keys))).alias("_header")
    slim = msgs.where(F.col(client_col).isNotNull()).select(F.col(client_col).alias("_client"), *order, header)

    def passes(batches):
        client, history = None, []
        for batch in batches:
            take = []
            for c, h in zip(batch.column("_client").to_pylist(), batch.column("_header").to_pylist()):
                if c != client:
                    client, history = c, []
                new = h not in history
                take.append(new)
                if new:
                    history.append(h)
                    if len(history) == limit:
                        history = history[-keep:]
            yield batch.filter(pa.array(take, pa.bool_()))

    kept = slim.repartition("_client").sortWithinPartitions("_client", *order).mapInArrow(passes, slim.schema) \
        .select(F.col("_client").alias(client_col), *order)
    same = [msgs[c].eqNullSafe(kept[c]) for c in (client_col, *order)]
    return msgs.join(kept, same, "left_semi")


def route(msgs: DataFrame, type_col: str = "type_message") -> DataFrame:
    """The route of each message; unknown types become error rows."""
    known = F.col(type_col).isin(*S.MESSAGE_TYPES)
    return (msgs.withColumn("route", F.when(known, F.col(type_col)).otherwise(F.lit(S.UNKNOWN)))
            .withColumn("_error", F.when(known, F.lit(None).cast("string"))
                        .otherwise(F.lit("unknown message type"))))


def parse_body(msgs: DataFrame, route_name: str, body_col: str = "body") -> DataFrame:
    """Parse the JSON body of one route with its explicit schema (a map for routes without one).

    A body that does not parse gives a NULL ``doc`` and, in ``_corrupt``, only its md5 and
    length: broken text cannot be searched for secrets safely. Password fields are
    removed right here, before anything can be written.
    """
    from .documents import mask_secrets

    kind = S.BODY_SCHEMAS[route_name]
    rows = msgs.where(F.col("route") == route_name)
    note = F.concat(F.lit("md5 "), F.md5(F.coalesce(F.col(body_col), F.lit(""))), F.lit(", length "),
                    F.coalesce(F.length(body_col), F.lit(0)))
    if isinstance(kind, T.MapType):
        parsed = rows.withColumn("doc", F.from_json(F.col(body_col), kind))
        secret = F.array(*[F.lit(n) for n in S.SECRET_FIELDS])
        parsed = parsed.withColumn("doc", F.map_filter("doc", lambda k, v: ~F.array_contains(secret, k)))
        return parsed.withColumn("_corrupt", F.when(F.col("doc").isNull(), note)).drop(body_col)
    schema = T.StructType(kind.fields + [T.StructField("_corrupt_record", T.StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = rows.withColumn("doc", F.from_json(F.col(body_col), schema, opts))
    broken = F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()
    parsed = (parsed.withColumn("_corrupt", F.when(broken, note))
              .withColumn("doc", F.when(~broken, F.col("doc").dropFields("_corrupt_record")))
              .drop(body_col))
    return mask_secrets(parsed, "doc")
