"""The message front end as one keyed state: registry as of message time, expiring
de-duplication, late rows (X2, X4, P1, P2, W2).

Registry changes and messages are one stream, keyed by (client, salt). A row waits in the state
until the watermark has passed its time; then the rows of a key are taken in order of time:

* a change sets the client's stored hash;
* a message is gated on the hash as it was at its time, so a change that comes later, or arrives
  in another micro-batch, does not matter;
* a copy of an accepted message within ``keep`` of it is a repeat; after that its key has expired (a
  timer removes it) and a copy runs again;
* a row older than the watermark on arrival cannot take its place any more: a late
  message is returned as such, a late change still sets the hash if it is the newest one.

A message's salt comes from its de-duplication key, and changes go to every salt, so a client that
sends a third of all messages is ``salts`` keys. Every row comes out once, with its ``status``:
accepted, repeat, rejected (hash), unknown (client not registered by then) or late. The result depends
on micro-batches only in what is late. As batch: ``operators.messages.accept_messages_asof``.

A call to the state is a message to Spark, and so is a key's call, so clients share keys: a key is one of
``buckets`` times a salt, and holds its clients' rows as Arrow blocks. The work then goes with the rows, not with the clients.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..operators.messages import DEDUP_KEYS
from ..session import CLUSTER_CONF

STATUS_SCHEMA = "client_id string, ts timestamp, status string, payload string"
_ROW = pa.schema([("client_id", pa.string()), ("ts", pa.int64()), ("kind", pa.int32()), ("tie", pa.string()), ("copy", pa.string()),
                  ("gated", pa.bool_()), ("checksum", pa.string()), ("payload", pa.string())])
_HASH = pa.schema([("client_id", pa.string()), ("ts", pa.int64()), ("tie", pa.string()), ("env_hash", pa.string())])
_COPY = pa.schema([("copy", pa.string()), ("ts", pa.int64())])
_BLOCK = "block binary"


def _packed(table: pa.Table) -> tuple[bytes]:
    """A table as one value of the state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value: tuple) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(value[0])).read_all()


class BucketGate(StatefulProcessor):
    """Times are microseconds; a timer is in milliseconds, rounded up. A key has a timer for its earliest row or expiry."""

    def __init__(self, keep_us: int) -> None:
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _BLOCK)    # rows that the watermark has not passed
        self.hashes = handle.getValueState("hashes", _BLOCK)     # each client's newest hash
        self.accepted = handle.getValueState("accepted", _BLOCK)  # copies that would be repeats

    def _out(self, clients: list, ts: list, status: list, payload: list) -> Iterator[pd.DataFrame]:
        if status:
            yield pd.DataFrame({"client_id": clients, "ts": pd.to_datetime(ts, unit="us"), "status": status, "payload": payload})

    def _held(self) -> dict[str, tuple]:
        """client -> time, tie and hash of its newest change."""
        value = self.hashes.get()
        if value is None:
            return {}
        client, *change = (c.to_pylist() for c in _unpacked(value).columns)
        return dict(zip(client, zip(*change)))

    def _hold(self, held: dict[str, tuple]) -> None:
        self.hashes.update(_packed(pa.table([list(held), *map(list, zip(*held.values()))], schema=_HASH)))

    @staticmethod
    def _take(held: dict[str, tuple], client: str, change: tuple) -> bool:
        """Whether a change (time, tie, hash) is later than the client's stored hash; then it is stored."""
        before = held.get(client)
        if before is None or before[:2] <= change[:2]:
            held[client] = change
            return True
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        earliest, changes = None, []
        for frame in rows:
            block = pa.Table.from_pandas(frame[_ROW.names], schema=_ROW, preserve_index=False)
            ahead = pc.greater_equal(block["ts"], mark)
            wait, past = block.filter(ahead), block.filter(pc.invert(ahead))
            if wait.num_rows:
                self.waiting.appendList([_packed(wait)])
                first = pc.min(wait["ts"]).as_py()
                earliest = first if earliest is None else min(earliest, first)
            if past.num_rows:
                changed = past.filter(pc.equal(past["kind"], 0))
                changes += zip(*(changed[c].to_pylist() for c in ("client_id", "ts", "tie", "checksum")))
                late = past.filter(pc.equal(past["kind"], 1))
                yield from self._out(*(late[c].to_pylist() for c in ("client_id", "ts")), ["late"] * late.num_rows, late["payload"].to_pylist())
        if changes:
            held = self._held()
            if any([self._take(held, client, tuple(change)) for client, *change in changes]):
                self._hold(held)
        if earliest is not None:
            self._wake(earliest)

    def _wake(self, ts: int) -> None:
        self.handle.registerTimer(-(-ts // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Takes all rows that the watermark has passed, however many timers stand for them, and sets the next timer."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [_unpacked(value) for value in self.waiting.get()]
        rows = pa.concat_tables(blocks) if blocks else _ROW.empty_table()
        passed = pc.less(rows["ts"], mark)
        ready, rest = rows.filter(passed), rows.filter(pc.invert(passed))
        ready = ready.sort_by([("ts", "ascending"), ("kind", "ascending"), ("tie", "ascending")])
        value = self.accepted.get()
        first = dict(zip(*(c.to_pylist() for c in _unpacked(value).columns))) if value is not None else {}
        before = len(first)
        held, newer, taken, status = self._held() if ready.num_rows else {}, False, False, []
        for client, ts, kind, tie, copy, gated, checksum in zip(*(ready[c].to_pylist() for c in _ROW.names[:-1])):
            if kind == 0:
                newer = self._take(held, client, (ts, tie, checksum)) or newer
                continue
            stored, was = held.get(client), first.get(copy)
            if stored is None:
                status.append("unknown")
            elif gated and checksum != stored[2]:
                status.append("rejected")
            elif was is not None and ts < was + self.keep_us:
                status.append("repeat")
            else:
                first[copy] = ts
                taken = True
                status.append("accepted")
        live = {copy: ts for copy, ts in first.items() if ts + self.keep_us > mark}
        if taken or len(live) != before:
            self.accepted.update(_packed(pa.table([list(live), list(live.values())], schema=_COPY))) if live else self.accepted.clear()
        if newer:
            self._hold(held)
        if ready.num_rows:
            self.waiting.put([_packed(rest)]) if rest.num_rows else self.waiting.clear()
        ahead = [pc.min(rest["ts"]).as_py()] if rest.num_rows else []
        ahead += [min(live.values()) + self.keep_us] if live else []
        if ahead:
            self._wake(min(ahead))
        asked = ready.filter(pc.equal(ready["kind"], 1))
        yield from self._out(*(asked[c].to_pylist() for c in ("client_id", "ts")), status, asked["payload"].to_pylist())

    def close(self) -> None:
        pass


_CLIENT_ROW = "ts long, kind int, tie string, copy string, gated boolean, checksum string, payload string"
_NAMES = [f.split()[0] for f in _CLIENT_ROW.split(", ")]


class Gate(StatefulProcessor):
    """The state of one client and salt, for checkpoints that were begun with it. Times are microseconds; a timer is in milliseconds, rounded up. A key has a timer for its earliest row or expiry."""

    def __init__(self, keep_us: int) -> None:
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _CLIENT_ROW)
        self.hash = handle.getValueState("hash", "ts long, tie string, env_hash string")
        self.accepted = handle.getListState("accepted", "copy string, ts long")

    def _out(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({"client_id": key[0], "ts": pd.to_datetime([r[0] for r in rows], unit="us"),
                                "status": [r[1] for r in rows], "payload": [r[2] for r in rows]})

    @staticmethod
    def _newer(held: tuple | None, change: tuple) -> tuple:
        """The later of the stored hash and a change (time, tie, hash)."""
        return change if held is None or (held[0], held[1]) <= change[:2] else held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        late, wait, changes = [], [], []
        for frame in rows:
            for r in frame[_NAMES].itertuples(index=False, name=None):
                ts, kind, tie, _, _, checksum, payload = r
                if ts >= mark:
                    wait.append((int(ts), int(kind), tie, r[3], bool(r[4]), checksum, payload))
                elif kind == 0:
                    changes.append((int(ts), tie, checksum))
                else:
                    late.append((int(ts), "late", payload))
        if changes:
            held = self.hash.get()
            for change in changes:
                held = self._newer(held, change)
            self.hash.update(tuple(held))
        if wait:
            self.waiting.appendList(wait)
            self._wake(min(w[0] for w in wait))
        yield from self._out(key, late)

    def _wake(self, ts: int) -> None:
        self.handle.registerTimer(-(-ts // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Takes all rows that the watermark has passed, however many timers stand for them, and sets the next timer.

        Each call to the state is a message to Spark, so the state is read and written once, not by row.
        """
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        ready = sorted((r for r in rows if r[0] < mark), key=lambda r: (r[0], r[1], r[2]))
        rest = [tuple(r) for r in rows if r[0] >= mark]
        first = {copy: ts for copy, ts in self.accepted.get()}
        begun = dict(first)
        held = stored = self.hash.get()
        out = []
        for ts, kind, tie, copy, gated, checksum, payload in ready:
            if kind == 0:
                held = self._newer(held, (ts, tie, checksum))
                continue
            if held is None:
                out.append((ts, "unknown", payload))
            elif gated and checksum != held[2]:
                out.append((ts, "rejected", payload))
            elif copy in first and ts < first[copy] + self.keep_us:
                out.append((ts, "repeat", payload))
            else:
                first[copy] = ts
                out.append((ts, "accepted", payload))
        live = {copy: ts for copy, ts in first.items() if ts + self.keep_us > mark}
        if live != begun:
            self.accepted.put(list(live.items())) if live else self.accepted.clear()
        if held is not stored:
            self.hash.update(tuple(held))
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        ahead = [r[0] for r in rest] + [ts + self.keep_us for ts in live.values()]
        if ahead:
            self._wake(min(ahead))
        yield from self._out(key, out)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which this kind of state needs (a cluster sets it for all)."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, CLUSTER_CONF[name])
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def gated_stream(msgs: DataFrame, changes: DataFrame, watermark: str = "1 hour", keep_seconds: int = 3600,
                 salts: int = 4, tie_col: str = "msg_id", change_tie_col: str | None = None, buckets: int | None = 256) -> DataFrame:
    """Status of every message: client_id, ts, status, payload (the message as JSON, secrets unparsed in its body).

    ``msgs``: a stream with the columns of ``MESSAGE_SCHEMA`` in use (codes normalised); ``changes``: a stream of client_id,
    changed_ts, env_hash. ``tie_col`` orders messages of one time. Rows without client or time are left out.
    ``buckets`` times ``salts`` keys hold the state, so a key's share of the waiting rows has to fit a task; both stay as they
    are for the life of a checkpoint. None gives each client keys of its own, as checkpoints begun before buckets have it.
    """
    copy = F.to_json(F.struct(*DEDUP_KEYS))
    salt = F.pmod(F.xxhash64(*DEDUP_KEYS), F.lit(salts)).cast("int")
    asked = msgs.where(F.col("client_id").isNotNull()).select(
        "client_id", salt.alias("salt"), F.col("arrival_ts").cast("timestamp").alias("_at"), F.lit(1).alias("kind"),
        F.col(tie_col).cast("string").alias("tie"), copy.alias("copy"),
        F.coalesce(F.col("type_message").isin(*S.CHECKSUM_TYPES), F.lit(False)).alias("gated"), F.col("checksum").alias("checksum"),
        F.to_json(F.struct(*msgs.columns)).alias("payload"))
    change_tie = F.col(change_tie_col).cast("string") if change_tie_col else F.lit("")
    known = changes.where(F.col("client_id").isNotNull()).select(
        "client_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("changed_ts").cast("timestamp").alias("_at"),
        F.lit(0).alias("kind"), change_tie.alias("tie"), F.lit("").alias("copy"), F.lit(False).alias("gated"),
        F.col("env_hash").alias("checksum"), F.lit("").alias("payload"))
    both = asked.unionByName(known).where(F.col("_at").isNotNull()).withWatermark("_at", watermark)
    # The watermark's own column ends here, so late rows reach the state instead of being dropped before it.
    names, keep_us = _ROW.names[2:], keep_seconds * 1_000_000
    if buckets is None:
        rows, keys, gate = both.select("client_id", "salt", F.unix_micros("_at").alias("ts"), *names), ["client_id", "salt"], Gate(keep_us)
    else:
        bucket = F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int").alias("bucket")
        rows = both.select(bucket, "salt", "client_id", F.unix_micros("_at").alias("ts"), *names)
        keys, gate = ["bucket", "salt"], BucketGate(keep_us)
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=gate, outputStructType=STATUS_SCHEMA, outputMode="Append", timeMode="EventTime")
