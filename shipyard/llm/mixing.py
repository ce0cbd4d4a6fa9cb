"""Mixing sources to target weights with DataFrame operations alone.

Each source gets a target number of words (:func:`source_targets`). Complete epochs
come first: every document of a source is taken floor(target / size of the source)
times. What is left is filled by weighted sampling without replacement after
Efraimidis and Spirakis: each document draws an exponential key, divided by its
quality weight, and the smallest keys are taken until their sizes add up to the
budget.

The sort by key and its prefix sums are done in two levels, so no source passes
through one task: keys fall into many narrow ranges per source, the ranges' sums are
added up in order, and only the one range in which the budget ends is sorted, one entry
per key. The outcome per source is one cut (range, key, id), which any row can be
compared with.

Rows that repeat id and text draw one key. Where the budget ends among such rows, as many
of them are taken as fit; they are counted in chunks, so that a row repeated without
bound does not meet in one task either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize_table

#: No source is repeated more often.
MAX_REPEATS = 3
#: Rows that one key range holds, roughly.
RANGE_ROWS = 5_000
#: Rows numbered at a time where the budget ends among equal rows.
CHUNK_ROWS = 4_096
SEED = "mix-2"


def word_count(text: str) -> Column:
    """Runs of anything but ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: str, size: Column) -> Column:
    """How far the number of letter runs agrees with the number of words: 0.05 to 1."""
    letters = F.coalesce(F.regexp_count(F.col(text), F.lit(r"\p{L}+")), F.lit(0))
    return F.when(size > 0, F.greatest(F.lit(0.05), 1.0 - F.abs(letters - size).cast("double") / size.cast("double"))
                  ).otherwise(F.lit(1.0))


def exponential_key(doc_id: str, text: str, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u from the id and the text: the same in every run, and of its own
    for each text that shares an id or has none."""
    named = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"),
                     F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with each source's ``target``.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on and share
    the total size. No target exceeds ``max_repeats`` times its source's size; the
    excess is shared by weight among the others until none is above. That end point
    is min(cap, weight * level) with one level for all: sources fill up in the order
    cap / weight, and the level is the largest of the levels met on the way. One row
    per source goes through one task here, never a document.
    """
    ranked = sizes.select(
        "source", "source_size",
        (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1)
        .cast("long").alias("weight"))
    caps = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    levels = caps.withColumn("level", level)
    return levels.select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(whole)).alias("target"))


@dataclass(frozen=True)
class Mix:
    """The plan of a mix: ``sources`` holds a row per source; ``resolution`` sets the key ranges;
    ``split`` tells whether a budget ends among rows that share a key."""

    sources: DataFrame
    resolution: int
    split: bool

    def copies(self, docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
        """Each row of ``docs`` as the struct ``_doc``, beside its ``_size``, ``_copies``,
        ``_source_size`` and ``_target``."""
        keyed = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_id"), F.col(source).alias("_source"),
                            F.col(text).alias("_text")).withColumn("_size", word_count("_text"))
        return self._apply(keyed.withColumn(
            "_key", exponential_key("_id", "_text", quality_weight("_text", F.col("_size")))).drop("_text"))

    def _apply(self, keyed: DataFrame) -> DataFrame:
        ranged = keyed.withColumn("_range", key_range(F.col("_key"), self.resolution))
        joined = ranged.join(self.sources, F.col("_source").eqNullSafe(F.col("_mix_source")))
        place = F.struct(F.col("_key").alias("k"), F.col("_id").alias("i"), F.col("_size").alias("s"))
        at_cut = (F.col("_range") == F.col("_cut_range")) & (place == F.col("_cut"))
        chosen = (F.col("_range") < F.col("_cut_range")) | (
            (F.col("_range") == F.col("_cut_range")) & (place <= F.col("_cut")))
        copies = F.col("_epochs") + F.coalesce(chosen, F.lit(False)).cast("long")
        joined = joined.withColumn("_copies", copies)
        if not self.split:
            return joined
        among = F.coalesce(at_cut & (F.col("_fit") < F.col("_equal")), F.lit(False))
        return joined.where(~among).unionByName(_first_rows(joined.where(among)))


def _first_rows(rows: DataFrame) -> DataFrame:
    """``rows``, of which only ``_fit`` per source keep their last copy. The rows are written
    once with their places in it, and counted per chunk of places."""
    placed = materialize_table(rows.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_chunk", F.floor(F.col("_at") / F.lit(CHUNK_ROWS)))
    chunks = placed.groupBy(F.col("_mix_source").alias("_s"), F.col("_chunk").alias("_c")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    before = chunks.select("_s", "_c", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_mix_source", "_chunk").orderBy("_at"))
    counted = placed.withColumn("_number", number).join(
        before, F.col("_mix_source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    beyond = (F.col("_before") + F.col("_number") > F.col("_fit")).cast("long")
    return counted.withColumn("_copies", F.col("_copies") - beyond).select(*rows.columns)


def key_range(key: Column, resolution: int) -> Column:
    return F.floor(F.log2(key) * resolution).cast("long")


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             max_repeats: int = MAX_REPEATS) -> tuple[Mix, DataFrame]:
    """The mix of ``docs`` and the table of sizes and keys it was made from.

    That table (_id, _source, _size, _key; no texts) is written once under
    spark.checkpoint.dir and read by each later step.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    rows = rows.withColumn("_size", word_count("_text"))
    rows = materialize_table(rows.select(
        "_id", "_source", "_size", exponential_key("_id", "_text", quality_weight("_text", F.col("_size"))).alias("_key")))
    resolution = max(64, rows.count() // (4 * RANGE_ROWS))

    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    goals = source_targets(sizes, max_repeats).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    ranged = rows.withColumn("_range", key_range(F.col("_key"), resolution))
    sums = ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    in_order = Window.partitionBy("_source").orderBy("_range")
    ends = sums.withColumn("_upto", F.sum("_sum").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    # The range in which the budget ends: the first one whose running sum reaches it.
    same = F.col("_source").eqNullSafe(F.col("source"))
    cuts = (
        ends.join(goals, same).where(F.col("_upto") >= F.col("rest"))
        .groupBy("source").agg(F.min(F.struct("_range", "_upto", "_sum")).alias("_c"))
        .select("source", F.col("_c._range").alias("cut_range"), (F.col("_c._upto") - F.col("_c._sum")).alias("base"))
    )
    joined = goals.alias("g").join(cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select(
        "g.source", "source_size", "target", "epochs", "rest", "cut_range", "base")
    goals = materialize_table(joined)
    edge = ranged.join(goals, same & (F.col("_range") == F.col("cut_range")))
    entries = edge.groupBy("_source", "_key", "_id", "_size", "base", "rest").agg(F.count("*").alias("_equal"))
    run = Window.partitionBy("_source").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("_size") * F.col("_equal")
    # A row is in when at least half of it lies within the budget: the sum ends nearest to it.
    room = F.col("rest") - (F.col("base") + F.sum(words).over(run) - words)
    fit = F.when(F.col("_size") == 0, F.when(room >= 0, F.col("_equal")).otherwise(F.lit(0))).otherwise(
        F.least(F.col("_equal"), F.floor(room / F.greatest(F.col("_size"), F.lit(1)) + 0.5)))
    inside = entries.withColumn("_fit", fit.cast("long")).where("_fit > 0")
    last = F.max(F.struct(F.col("_key").alias("k"), F.col("_id").alias("i"), F.col("_size").alias("s"),
                          F.col("_fit").alias("fit"), F.col("_equal").alias("equal")))
    cut = inside.groupBy(F.col("_source").alias("s")).agg(last.alias("_last"))
    plan = goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("_mix_source"), F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"), F.col("epochs").cast("long").alias("_epochs"),
        F.col("cut_range").alias("_cut_range"),
        F.when(F.col("_last").isNotNull(), F.struct("_last.k", "_last.i", "_last.s")).alias("_cut"),
        F.col("_last.fit").alias("_fit"), F.col("_last.equal").alias("_equal"))
    plan = materialize_table(plan)
    return Mix(plan, resolution, not plan.where("_fit < _equal").isEmpty()), rows


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of the document, repeats included.
    Null texts have size 0; a null source is a source of its own. Rows that repeat id and
    text draw one key; they are taken together, except where the budget ends among
    them: then as many as fit. An empty table gives no rows. Other columns are ignored.
    """
    mix, rows = plan_mix(docs, doc_id, text, source)
    return mix._apply(rows).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it (0 to 3 times),
    with the columns of ``docs``."""
    mix, _ = plan_mix(docs, doc_id, text, source)
    wide = mix.copies(docs, doc_id, text, source).where("_copies > 0")
    again = F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))
    return wide.select("_doc", again.alias("_again")).select("_doc.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+'))::BIGINT AS letters
  FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix-2:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / CASE WHEN size > 0 THEN greatest(0.05::DOUBLE, 1.0::DOUBLE - abs(letters - size)::DOUBLE / size::DOUBLE) ELSE 1.0 END AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS cap,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
