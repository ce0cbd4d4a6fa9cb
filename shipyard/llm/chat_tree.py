r"""Chat formatting as a prefix tree.

Conversations that share their first turns share these turns' nodes. The tree is laid
out depth-first as one sequence: every node's formatted text is emitted once, at
``start``. A node carries its position id (the length of what precedes it in its own
conversation) and the intervals of the layout that it may attend to, those of its
ancestors; neighbouring intervals are merged.

A node is named by a chained 128-bit hash of its path. The conversations' turns are sorted
and streamed: a task holds a turn at a time, however long the conversation. The layout
places chains, the nodes that one conversation owns (:func:`chains`): they are
range-partitioned by where they branch off, each partition adds up its lengths, and the
partitions' sums shift the offsets.

Template, with ``t`` the escaped text:

    user       <s>[INST] t [/INST]
    assistant  ` t </s>` (a leading space; ``t`` is what the loss is taken on)
    system     <<SYS>>\nt\n<</SYS>>\n\n
    others     [ROLE=r] t [/ROLE]   (r percent-encoded)

Escaping puts a backslash after the first character of a control string, or one more
where backslashes already follow it, and is undone by taking one away, so texts that
spell control strings come back as they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize_table

_REST = r"(?=/?s>|<SYS>>|</SYS>>|/?INST\]|ROLE=|/ROLE\])"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _REST)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _REST)
_ROLE_CODES = {"%": "%25", "]": "%5D", "[": "%5B", "<": "%3C"}
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where the text under the loss mask starts and ends in it."""
    t = escape(text)
    if role == "user":
        return f"<s>[INST] {t} [/INST]", 0, 0
    if role == LOSS_ROLE:
        return f" {t} </s>", 1, 1 + len(t)
    if role == "system":
        return f"<<SYS>>\n{t}\n<</SYS>>\n\n", 0, 0
    name = re.sub(r"[%\[\]<]", lambda m: _ROLE_CODES[m[0]], role)
    return f"[ROLE={name}] {t} [/ROLE]", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    turns, at = [], 0

    def upto(start: int, end: str) -> tuple[str, int]:
        k = formatted.index(end, start)
        return formatted[start:k], k + len(end)

    while at < len(formatted):
        if formatted.startswith("<s>[INST] ", at):
            role, (text, at) = "user", upto(at + 10, " [/INST]")
        elif formatted.startswith("<<SYS>>\n", at):
            role, (text, at) = "system", upto(at + 8, "\n<</SYS>>\n\n")
        elif formatted.startswith("[ROLE=", at):
            name, at = upto(at + 6, "] ")
            role = name
            for c, code in reversed(_ROLE_CODES.items()):
                role = role.replace(code, c)
            text, at = upto(at, " [/ROLE]")
        else:
            role, (text, at) = LOSS_ROLE, upto(at + 1, " </s>")
        turns.append((role, unescape(text)))
    return turns


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with each conversation in one task, in ``order``; only one row is held at a time."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def conversation_paths(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """One row per turn: conv_id, depth, node, parent, position, segment, size, loss_from, loss_to.

    Turns go by turn, then role, then text; null texts and roles count as empty. Rows
    with a null conversation id are one conversation.
    """
    said = _by_conversation(turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "turn", "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, depth, parent, position = object(), 0, "", 0
        for batch in batches:
            out = {n: [] for n in schema.names}
            for conv, by, what in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current:
                    current, depth, parent, position = conv, 0, "", 0
                segment, low, high = format_turn(by, what)
                node = hashlib.md5(f"{parent}|{segment}".encode()).hexdigest()
                for name, value in zip(out, (conv, depth, node, parent, position, segment, len(segment), low, high)):
                    out[name].append(value)
                depth, parent, position = depth + 1, node, position + len(segment)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([
        ("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.string()), ("parent", pa.string()),
        ("position", pa.int64()), ("segment", pa.string()), ("size", pa.int64()), ("loss_from", pa.int32()),
        ("loss_to", pa.int32())])
    return said.mapInArrow(
        walk, "conv_id long, depth int, node string, parent string, position long, segment string, size long, "
              "loss_from int, loss_to int")


def chains(lines: DataFrame) -> DataFrame:
    """One row per conversation that owns nodes: owner, key, first (position of its first node), size.

    A node's owner is the least conversation through it, so owners never get smaller
    along a path (a null id is the greatest), and a conversation owns the tail of its
    path: a chain. Depth first, with the owner's own continuation before other children, a
    chain is one stretch, and the branches off it follow, deepest first. ``key`` orders the
    chains so: for each chain on the path, where it branches off and whose it is. It
    grows with the branchings on a path, not with its turns.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(*rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        current, owner, key, first, end = object(), object(), [], 0, 0
        done: list[tuple] = []
        for batch in batches:
            for conv, depth, position, size, own in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "depth", "position", "size", "owner"))):
                if conv != current:
                    if key and owner == current:
                        done.append((owner, b"".join(key), first, end - first))
                    current, owner, key = conv, object(), []
                if own != owner:
                    # Big-endian: deeper branches first, then by owner, null last.
                    name = (1 << 64) if own is None else own + (1 << 63)
                    owner, first = own, position
                    key.append((0xFFFFFFFF - depth).to_bytes(4, "big") + name.to_bytes(9, "big"))
                end = position + size
            if done:
                yield packed(*done)
                done = []
        if key and owner == current:
            yield packed((owner, b"".join(key), first, end - first))

    schema = pa.schema([("owner", pa.int64()), ("key", pa.binary()), ("first", pa.int64()), ("size", pa.int64())])
    return _by_conversation(lines.select("conv_id", "depth", "position", "size", "owner"), "depth").mapInArrow(
        walk, "owner long, key binary, first long, size long")


def lay_out(found: DataFrame) -> DataFrame:
    """``owner`` and ``base`` of each chain: what a position in the owner's conversation is shifted by
    in the depth-first sequence of all nodes."""

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            starts = []
            for n in batch.column("size").to_pylist():
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in batch.schema.names] + [pa.array(starts, pa.int64())],
                names=[*batch.schema.names, "inner"])

    ordered = found.repartitionByRange("key").sortWithinPartitions("key").select("owner", "first", "size")
    placed = materialize_table(ordered.mapInArrow(offsets, "owner long, first long, size long, inner long").withColumn(
        "part", F.spark_partition_id()))
    # One row per partition; ranges follow each other in the order of the partitions.
    sums = placed.groupBy("part").agg((F.max(F.col("inner") + F.col("size"))).alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("shift"))
    return placed.join(shift, "part").select("owner", (F.col("inner") + F.col("shift") - F.col("first")).alias("base"))


def build_tree(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The emitted nodes and the conversations that pass through them.

    Nodes: node, parent, start, size, position, segment, loss_from, loss_to, and attend,
    the intervals [from, to) of its ancestors. Conversations: conv_id, depth, node, start,
    size. Lengths count code points. Empty conversations do not exist; an empty table
    gives no nodes. Columns besides the four named are ignored.
    """
    paths = materialize_table(conversation_paths(turns, conv_id, turn, role, text))
    nodes = paths.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("parent", "position", "segment", "size", "loss_from", "loss_to")],
        F.min("conv_id").alias("owner"))
    nodes = materialize_table(nodes)
    lines = materialize_table(paths.select("conv_id", "depth", "node", "position", "size").join(
        nodes.select("node", "owner"), "node"))
    bases = materialize_table(lay_out(materialize_table(chains(lines)))).withColumnRenamed("owner", "_owner")

    def started(rows: DataFrame) -> DataFrame:
        placed = rows.join(bases, F.col("owner").eqNullSafe(F.col("_owner")))
        return placed.withColumn("start", F.col("base") + F.col("position")).drop("_owner", "base")

    members = materialize_table(started(lines).select(
        "conv_id", "depth", "node", "start", "size", F.col("conv_id").eqNullSafe(F.col("owner")).alias("own")))

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = object(), []
        for batch in batches:
            node, intervals = [], []
            for conv, name, start, size, own in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "node", "start", "size", "own"))):
                if conv != current:
                    current, seen = conv, []
                if own:  # ancestors come with the one conversation that owns the node
                    node.append(name)
                    intervals.append([{"from": a, "to": b} for a, b in seen])
                if seen and seen[-1][1] == start:
                    seen[-1] = (seen[-1][0], start + size)
                else:
                    seen.append((start, start + size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.string()),
                 pa.array(intervals, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))],
                names=["_node", "attend"])

    intervals = _by_conversation(members, "depth").mapInArrow(
        attend, "_node string, attend array<struct<from: long, to: long>>")
    emitted = started(nodes).drop("owner").join(intervals, F.col("node") == F.col("_node")).drop("_node")
    return emitted, members.select("conv_id", "depth", "node", "start", "size")


def read_back(emitted: DataFrame, members: DataFrame) -> DataFrame:
    """Each conversation read from the emitted nodes: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Turns are parsed and digested one after the other."""
    segments = emitted.select("node", "segment", "loss_from", "loss_to")
    lines = members.join(segments, "node").select("conv_id", "depth", "segment", "loss_from", "loss_to")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(conv) -> pa.RecordBatch:
            values = conv, n_turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        current, n_turns, said, loss, loss_chars, chars = None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        for batch in batches:
            done = []
            for conv, segment, low, high in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "segment", "loss_from", "loss_to"))):
                if conv != current:
                    if n_turns:
                        done.append(packed(current))
                    current, n_turns, said, loss, loss_chars, chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, text in parse(segment):
                    said.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                under = unescape(segment[low:high])  # the mask marks places of the formatted turn
                loss.update(under.encode())
                loss_chars += len(under)
                chars += len(segment)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if n_turns:
            yield packed(current)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return _by_conversation(lines, "depth").mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
