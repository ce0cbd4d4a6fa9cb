"""Prefix trie of conversations, its subtree sums by an Euler tour.

Each distinct sequence of a conversation's first turns is a node; the conversations that
start with it are its members. A node is named by its least member and its depth.

1. ``rebuilt_turns``: turns get their place in the conversation. Rows are cut into
   range chunks of (conversation, order); places and prefix keys are running values inside
   a chunk, and what a chunk takes over from those before it is one value per chunk, so a
   conversation that holds a third of the rows is spread over many tasks. A prefix key is
   the exclusive or of 128 hashed bits per (place, turn): equal for equal prefixes only.
2. ``trie_nodes``: one aggregate over (depth, key); the parent's key is the own one
   without the last turn, so parents are found by one equi join.
3. ``euler_arcs``: an enter and an exit arc per node, linked to the arcs before and after.
   Children are ordered by (salt, name): a parent with very many children is linked
   salt by salt, and the salts' first and last children then to each other.
4. ``rank_list``: the tour is ranked by contraction. In each round every arc whose hash is
   less than both neighbours' leaves the list and gives its weight to the arc before it
   (about a third leave; one shuffle of what is left, written as a table). A list
   of at most ``BASE_ARCS`` is summed in one task; then the rounds are undone, each
   removed arc standing behind the one that took its weight. Work and shuffles are
   linear in the tour, the number of rounds is logarithmic.
5. ``subtree_sums``: a sum over a subtree is the prefix sum at its exit less that at its
   entry.

Rows: those with a null conversation id take no part; a null role or text is empty, a null
turn comes first; turns that tie are ordered by the md5 of role length, role and text, and
repeated rows are turns of their own. An empty table has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize_table

#: The rebuilding takes the first turns of the conversation that stands at the last multiple of this ...
STEP = 100
#: ... namely crc32(id) modulo this many.
SHARED = 6
#: A list of up to so many arcs is summed in one task.
BASE_ARCS = 16_384

KEY = ["depth", "k1", "k2"]
NODE = ["conv_id", "depth"]


def _salts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _turn_keys(place: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(F.lit(lane), place, digest).alias(f"g{lane}") for lane in (1, 2)]


def _chunk_carry(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per (conv_id, _chunk): each value over the conversation's earlier chunks (null before the first).

    ``values``: name -> aggregate; the aggregates of a conversation's chunks, at most one row a
    chunk, are combined by the same kind of aggregate.
    """
    own = rows.groupBy("conv_id", "_chunk").agg(*[v.alias(n) for n, v in values.items()])
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    fold = {n: (F.bit_xor if n.startswith("x") else F.sum)(n) for n in values}
    return own.select("conv_id", "_chunk", *[f.over(before).alias(f"_before_{n}") for n, f in fold.items()])


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), digest, chars and _chunk of every turn, as a table."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"),
        F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"), F.xxhash64(F.monotonically_increasing_id()).alias("_spread"))
    order = [F.col("_turn").asc_nulls_first(), F.col("digest"), F.col("_spread")]
    ranged = materialize_table(rows.repartitionByRange(_salts(turns), F.col("conv_id"), *order)
                               .withColumn("_chunk", F.spark_partition_id()))
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("conv_id", "_chunk").orderBy(*order)))
    carry = _chunk_carry(ranged, {"n": F.count(F.lit(1))})
    placed = local.join(carry, ["conv_id", "_chunk"])
    return materialize_table(placed.select("conv_id", (F.col("_at") - 1 + F.coalesce("_before_n", F.lit(0))).alias("pos"),
                                           "digest", "chars", "_chunk"))


def _crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' prefixes, and the conversations.

    Prefixes: conv_id, depth (from 1), k1, k2 (key of the first ``depth`` turns), g1, g2 (of the
    last one), chars. Conversations: conv_id, n_turns.
    """
    base = placed.where((F.col("conv_id") % STEP == 0) & (F.col("pos") < SHARED - 1)).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("first"))  # at most SHARED - 1 turns
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")).select(
        "conv_id", "n_own", (_crc("conv_id") % SHARED).alias("h"), (F.col("conv_id") - F.col("conv_id") % STEP).alias("_base"))
    convs = convs.join(base.withColumnRenamed("conv_id", "_base"), "_base", "left")
    shared = F.when(F.col("h") > 0, F.slice(F.coalesce("first", F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>")),
                                            F.lit(1), F.greatest("h", F.lit(1)).cast("int")))
    shared = F.coalesce(shared, F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>"))
    convs = materialize_table(convs.select("conv_id", "n_own", "h", shared.alias("shared")))
    n_shared = F.size("shared").cast("long")

    taken = convs.select("conv_id", F.explode("shared").alias("t")).select(
        "conv_id", F.col("t.pos").alias("place"), F.col("t.digest").alias("digest"), F.col("t.chars").alias("chars"))
    taken = taken.select("conv_id", "place", "chars", *_turn_keys(F.col("place"), F.col("digest")))
    up_to = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = taken.select("*", *[F.bit_xor(f"g{i}").over(up_to).alias(f"k{i}") for i in (1, 2)])  # at most SHARED - 1 rows
    whole = taken.groupBy("conv_id").agg(*[F.bit_xor(f"g{i}").alias(f"_s{i}") for i in (1, 2)])

    own = placed.join(convs.select("conv_id", "h", n_shared.alias("_n")), "conv_id").where(F.col("pos") >= F.col("h"))
    own = own.withColumn("place", F.col("_n") + F.col("pos") - F.col("h"))
    own = own.select("conv_id", "_chunk", "place", "chars", *_turn_keys(F.col("place"), F.col("digest")))
    inside = (Window.partitionBy("conv_id", "_chunk").orderBy("place")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = own.select("*", *[F.bit_xor(f"g{i}").over(inside).alias(f"_l{i}") for i in (1, 2)])
    carry = _chunk_carry(own, {"x1": F.bit_xor("g1"), "x2": F.bit_xor("g2")})
    local = local.join(carry, ["conv_id", "_chunk"]).join(whole, "conv_id", "left")
    keys = [F.col(f"_l{i}").bitwiseXOR(F.coalesce(f"_before_x{i}", F.lit(0))).bitwiseXOR(F.coalesce(f"_s{i}", F.lit(0))).alias(f"k{i}")
            for i in (1, 2)]
    columns = ["conv_id", (F.col("place") + 1).alias("depth"), "k1", "k2", "g1", "g2", "chars"]
    prefixes = taken.select(*columns).unionByName(
        local.select("conv_id", "place", "g1", "g2", "chars", *keys).select(*columns))
    turns = n_shared + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    return materialize_table(prefixes), convs.select("conv_id", turns.alias("n_turns"))


def trie_nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node, as a table: key, conv_id, n_convs, chars (of its last text), parent_conv_id."""
    nodes = prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                       *[F.min(c).alias(c) for c in ("chars", "g1", "g2")])
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"),
                       zero.alias("g1"), zero.alias("g2"))
    nodes = materialize_table(nodes.unionByName(root))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("_p1"), F.col("k2").alias("_p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    below = nodes.withColumn("_p1", F.col("k1").bitwiseXOR(F.col("g1"))).withColumn("_p2", F.col("k2").bitwiseXOR(F.col("g2")))
    return materialize_table(below.join(parents, ["depth", "_p1", "_p2"], "left").drop("_p1", "_p2", "g1", "g2"))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds _next and _prev (the siblings beside each node), _first, _last (its outer children), n_children."""
    kids = nodes.where("depth > 0").select(
        "parent_conv_id", "depth", "conv_id", F.pmod(F.xxhash64("conv_id"), F.lit(_salts(nodes))).alias("_salt"))
    family = ["parent_conv_id", "depth"]
    salted = Window.partitionBy(*family, "_salt").orderBy("conv_id")
    inner = kids.select(*family, "_salt", "conv_id", F.lead("conv_id").over(salted).alias("_n"),
                        F.lag("conv_id").over(salted).alias("_p"))
    ends = kids.groupBy(*family, "_salt").agg(F.min("conv_id").alias("_lo"), F.max("conv_id").alias("_hi"),
                                              F.count(F.lit(1)).alias("_c"))
    across = Window.partitionBy(*family).orderBy("_salt")  # a row per salt
    linked = ends.select(*family, "_salt", F.lead("_lo").over(across).alias("_after"), F.lag("_hi").over(across).alias("_before"))
    beside = inner.join(linked, [*family, "_salt"]).select(
        "conv_id", "depth", F.coalesce("_n", "_after").alias("_next"), F.coalesce("_p", "_before").alias("_prev"))
    outer = ends.groupBy(*family).agg(F.min(F.struct("_salt", "_lo")).alias("_f"), F.max(F.struct("_salt", "_hi")).alias("_l"),
                                      F.sum("_c").alias("n_children"))
    outer = outer.select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"),
                         F.col("_f._lo").alias("_first"), F.col("_l._hi").alias("_last"), "n_children")
    return nodes.join(outer, NODE, "left").join(beside, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def euler_arcs(nodes: DataFrame) -> DataFrame:
    """The tour, two arcs per node: c, a (2 * depth, and 1 more for the exit), before and after, weights."""
    d = F.col("depth")

    def arc(conv: Column, depth: Column, leaves: bool) -> tuple[Column, Column]:
        return conv, F.when(conv.isNotNull(), depth * 2 + int(leaves))

    def pick(cond: Column, yes: tuple, no: tuple) -> tuple:
        return tuple(F.when(cond, y).otherwise(n) for y, n in zip(yes, no))

    me, up = F.col("conv_id"), F.col("parent_conv_id")
    leaf = F.col("n_children") == 0
    into = {"before": pick(F.col("_prev").isNull(), arc(up, d - 1, False), arc(F.col("_prev"), d, True)),
            "after": pick(leaf, arc(me, d, True), arc(F.col("_first"), d + 1, False)),
            "w": (leaf.cast("long"), (F.col("n_convs") - 1) * F.col("chars"))}
    out = {"before": pick(leaf, arc(me, d, False), arc(F.col("_last"), d + 1, True)),
           "after": pick(F.col("_next").isNull(), arc(up, d - 1, True), arc(F.col("_next"), d, False)),
           "w": (F.lit(0).cast("long"), F.lit(0).cast("long"))}

    def row(x: dict, leaves: int) -> Column:
        return F.struct(me.alias("c"), (d * 2 + leaves).alias("a"), x["before"][0].alias("pc"), x["before"][1].alias("pa"),
                        x["after"][0].alias("sc"), x["after"][1].alias("sa"), x["w"][0].alias("w1"), x["w"][1].alias("w2"))

    return nodes.select(F.explode(F.array(row(into, 0), row(out, 1))).alias("r")).select("r.*")


ARC = ["c", "a", "pc", "pa", "sc", "sa", "w1", "w2"]


def _round(arcs: DataFrame, k: int) -> DataFrame:
    """Removes the arcs whose hash is least among themselves and their neighbours.

    Per remaining arc: its links and weights as they were, and in n* what replaces them.
    """
    mine, left, right = (F.xxhash64(F.lit(k), *[F.col(x) for x in at]) for at in (("c", "a"), ("pc", "pa"), ("sc", "sa")))
    gone = F.col("pc").isNotNull() & F.col("sc").isNotNull() & (mine < left) & (mine < right)
    names = [*ARC, "nsc", "nsa", "nw1", "nw2", "npc", "npa"]

    def row(**values: str) -> Column:
        return F.struct(*[(F.col(values[n]) if n in values else F.lit(None)).cast("long").alias(n) for n in names])

    to_left = row(c="pc", a="pa", nsc="sc", nsa="sa", nw1="w1", nw2="w2")
    to_right = row(c="sc", a="sa", npc="pc", npa="pa")
    sent = arcs.select(F.explode(F.when(gone, F.array(to_left, to_right)).otherwise(F.array(row(**{n: n for n in ARC})))).alias("m"))
    # Each field of an arc comes from one message at most.
    return sent.select("m.*").groupBy("c", "a").agg(*[F.max(n).alias(n) for n in names[2:]])


def _contracted(rows: DataFrame) -> DataFrame:
    return rows.select("c", "a", *[F.coalesce(f"n{x}", x).alias(x) for x in ("pc", "pa", "sc", "sa")],
                       *[(F.col(w) + F.coalesce(f"n{w}", F.lit(0))).alias(w) for w in ("w1", "w2")])


def _walk(arcs: DataFrame) -> DataFrame:
    """The sums before each arc of a short list: c, a, p1, p2."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {(r["c"], r["a"]): r for b in batches for r in b.to_pylist()}
        at = next((k for k, r in rows.items() if r["pc"] is None), None)
        found, p1, p2 = [], 0, 0
        while at is not None:
            r = rows[at]
            found.append((*at, p1, p2))
            p1, p2 = p1 + r["w1"], p2 + r["w2"]
            at = (r["sc"], r["sa"]) if r["sc"] is not None else None
        if len(found) != len(rows):
            raise RuntimeError("the tour is not one list")
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["c", "a", "p1", "p2"])

    return arcs.repartition(1).mapInArrow(work, "c long, a long, p1 long, p2 long")


def rank_list(arcs: DataFrame, base_arcs: int = BASE_ARCS) -> DataFrame:
    """Sums of both weights over all arcs before each one: c, a, p1, p2."""
    rows = materialize_table(arcs)
    rounds: list[DataFrame] = []
    while rows.count() > base_arcs:
        rounds.append(materialize_table(_round(rows, len(rounds))))
        rows = _contracted(rounds[-1])
    sums = materialize_table(_walk(rows))
    for done in reversed(rounds):
        took = done.where(F.col("nsc").isNotNull()).select("c", "a", F.col("sc").alias("_c"), F.col("sa").alias("_a"), "w1", "w2")
        back = took.join(sums, ["c", "a"]).select(F.col("_c").alias("c"), F.col("_a").alias("a"), (F.col("p1") + F.col("w1")).alias("p1"),
                                                  (F.col("p2") + F.col("w2")).alias("p2"))
        sums = materialize_table(sums.unionByName(back))
    return sums


def subtree_sums(sums: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: the sums at the exit less those at the entry."""
    leaves = F.col("a") % 2 == 1
    span = [(F.max(F.when(leaves, F.col(p))) - F.max(F.when(~leaves, F.col(p)))).alias(n)
            for p, n in (("p1", "n_leaves"), ("p2", "saved_tokens"))]
    depth = F.floor(F.col("a") / 2).cast("long")
    return sums.groupBy(F.col("c").alias("conv_id"), depth.alias("depth")).agg(*span)


def end_digests(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node key at which conversations end: SHA-256 of their ids, ascending, comma-joined.

    The ids are sorted by range over all tasks and written out as text there; a node's texts
    then run through one digest, in order, without being held.
    """
    last = prefixes.join(convs.select("conv_id", F.col("n_turns").alias("depth")), NODE).select(*KEY, "conv_id")
    zero = F.lit(0).cast("long")
    none = convs.where("n_turns = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    ends = last.unionByName(none)

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in KEY])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spans = list(runs(batch))
            ids = batch.column("conv_id").to_pylist()
            first = pa.array([low for low, _ in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(first) for c in [*KEY, "conv_id"]]
                + [pa.array([",".join(map(str, ids[low:high])) for low, high in spans], pa.string())], [*KEY, "first", "ids"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out(done: list) -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:3]] + [pa.array(columns[3], pa.string())],
                                              [*KEY, "ends_sha256"])

        for batch in batches:
            done = []
            for *k, ids in zip(*[batch.column(c).to_pylist() for c in [*KEY, "ids"]]):
                if k != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield out(done)
        if key is not None:
            yield out([(*key, state.hexdigest())])

    longs = ", ".join(f"{c} long" for c in KEY)
    texts = ends.repartitionByRange(_salts(prefixes), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id") \
        .mapInArrow(write, f"{longs}, first long, ids string")
    return texts.repartition(_salts(prefixes), *KEY).sortWithinPartitions(*KEY, "first") \
        .mapInArrow(digest, f"{longs}, ends_sha256 string")


def prefix_trie(turns: DataFrame, base_arcs: int = BASE_ARCS, **columns: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations with their subtree sums (see the module).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prefixes, convs = rebuilt_turns(ordered_turns(turns, **columns))
    nodes = materialize_table(with_siblings(trie_nodes(prefixes, convs)))
    sums = subtree_sums(rank_list(euler_arcs(nodes), base_arcs))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children").join(sums, NODE) \
        .join(end_digests(prefixes, convs), KEY, "left") \
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


#: The same by paths: every node of a conversation is an ancestor of its later ones.
ORACLE = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT c, c - c % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda v, z: xor(v // 2, (v % 2) * 3988292384))), 4294967295) % 6 AS h
  FROM t),
rebuilt AS (
  SELECT v.c, row_number() OVER (PARTITION BY v.c ORDER BY part, pos) AS d, role, text FROM (
    SELECT k.c, 0 AS part, t.pos, t.role, t.text FROM convs k JOIN t ON t.c = k.base AND t.pos < k.h
    UNION ALL
    SELECT k.c, 1, t.pos, t.role, t.text FROM convs k JOIN t ON t.c = k.c AND t.pos >= k.h) v),
paths AS (
  SELECT c, d, length(text) AS chars, md5(string_agg(md5(length(role)::VARCHAR || ':' || role || text), '' )
         OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
named AS (SELECT *, min(c) OVER (PARTITION BY d, k) AS node FROM paths),
depths AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
nodes AS (SELECT node, d, count(*) AS n_convs, any_value(chars) AS chars FROM named GROUP BY node, d),
tree AS (
  SELECT n.node, n.d, n.n_convs, n.chars, p.node AS parent FROM nodes n
  LEFT JOIN named p ON p.c = n.node AND p.d = n.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY ALL),
full_tree AS (SELECT tree.*, coalesce(n_children, 0) AS n_children FROM tree LEFT JOIN kids USING (node, d)),
sums AS (
  SELECT a.node, a.d, sum((n.n_children = 0)::INT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM full_tree n JOIN named a ON a.c = n.node AND a.d <= n.d GROUP BY a.node, a.d),
ends AS (SELECT n.node, n.d, string_agg(n.c::VARCHAR, ',' ORDER BY n.c) AS ids FROM named n JOIN depths USING (c, d) GROUP BY n.node, n.d)
SELECT f.node AS conv_id, f.d::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
  f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_tree f JOIN sums s USING (node, d) LEFT JOIN ends e USING (node, d)
"""
