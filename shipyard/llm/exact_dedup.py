"""Exact de-duplication with DataFrame operations alone.

Rows are grouped by the 128-bit hash of their text and, inside a hash, by the bytes
themselves: two different texts under one hash stay two classes. The whole text
crosses the network once, pre-aggregated by each map task, so a group of copies of
any size arrives as one row per task. The way back from a class to its rows carries
digests only; that join has one row per class on one side, so Spark may split its
large partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def content_hash(body: Column) -> Column:
    """The 128-bit hash of a text (hex)."""
    return F.md5(body.cast("binary"))


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash128=content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal (null counts as empty). ``keep_id`` is
    the largest id of the class and ``kept`` marks the row that bears it; rows that
    repeat both id and text are the same document and are all marked. A class without
    any id keeps its rows. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), _body(text).alias("_body"))
    keyed = rows.select("doc_id", "_body", hash128(F.col("_body")).alias("_hash"))
    classes = (
        keyed.groupBy("_hash", "_body")  # by hash, then byte by byte
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2(F.col("_body").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # A class is named by both digests (384 bits). The join below needs its own exchange of the
    # classes, one row each, so that large partitions of copies can be split.
    digests = keyed.select(
        "doc_id", "_hash", F.sha2(F.col("_body").cast("binary"), 256).alias("text_sha256"))
    return digests.join(classes, ["_hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without exact copies: of equal texts, the row with the largest id stays.

    Exactly one row of each class stays, also where id and text repeat (then the row
    whose other columns sort last). A null text and an empty one are equal; the
    kept row's text is returned as it was. Columns and their order are those of ``docs``.
    """
    names = docs.columns
    other = [c for c in names if c not in (doc_id, text)]
    fields = [F.col(doc_id).alias("id"), F.col(text).isNotNull().alias("given")]
    fields += [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(other)]
    tie = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(other)])) if other else F.lit("")
    slim = docs.select(_body(text).alias("body"), F.struct(*fields).alias("row"),
                       F.struct(F.col(doc_id).alias("id"), F.col(text).isNotNull().alias("given"),
                                tie.alias("tie")).alias("rank"))
    kept = slim.groupBy(content_hash(F.col("body")).alias("hash"), "body").agg(F.max_by("row", "rank").alias("row"))
    back = {doc_id: F.col("row.id"), text: F.when(F.col("row.given"), F.col("body"))}
    back |= {c: F.col(f"row.c{k}") for k, c in enumerate(other)}
    return kept.select(*[back[c].alias(c) for c in names])


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
c AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, c.keep_id, c.group_size, d.doc_id = c.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN c ON d.body = c.body
"""
