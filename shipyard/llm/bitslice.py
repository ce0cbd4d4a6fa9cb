"""Exact top-k inner products over a bit-sliced index.

The index holds, per block of rows, each attribute's integer values as bit planes: one
bitmap over the rows for each binary digit. A query's scores are added up for all rows
of a block at once by bitmap arithmetic: each digit of a query component adds the
attribute's planes at its place, and columns of bitmaps are reduced with carry-save
adders until one bitmap per digit of the score is left. The best rows are then picked
from the most significant digit downward; rows that tie at the boundary go by their id.
Nothing is approximate, and every row is in the index.

Queries are dealt in blocks as well, and a block of queries meets every block of rows.
Each task sees one pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
QUERY_ROWS = 512
#: Quantised components beyond it count as it; a score of 128 of them still fits two longs.
LARGEST = 1 << 59
#: Binary digits of the lower of the two longs that carry a score.
LOW_DIGITS = 62


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``id`` and ``x`` = floor(scale * component) of each usable vector, equal rows once.

    Vectors that are null or hold a null or non-finite component, and rows without an
    id, take no part. Quantised components beyond ``LARGEST`` count as ``LARGEST``, on
    either side of zero.
    """
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    end = F.lit(float(LARGEST))
    x = F.transform(embedding, lambda x: F.floor(
        F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), -end), end)).cast("long"))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
    return rows.where(whole).select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).dropDuplicates(["id", "x"])


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as a matrix; shorter ones count as filled up with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, :min(len(r), width)] = r[:width]
    return out


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: ``block``, ``n``, ``dims``, ``bits``, ``low`` (subtracted from all
    values), ``ids`` and ``planes`` (dims x bits bitmaps of 64-bit words)."""
    blocks = max(1, -(-rows.count() // block_rows))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        width = max(len(r) for r in frame["x"])
        values = _matrix(frame["x"], width)
        low = int(values.min()) if values.size else 0
        values = (values - low).astype(np.uint64)
        bits = int(values.max()).bit_length() if values.size else 0
        words = -(-len(frame) // 64)
        planes = np.zeros((width, bits, words), np.uint64)
        for b in range(bits):
            digit = np.zeros((width, words * 64), np.uint8)
            digit[:, :len(frame)] = ((values >> np.uint64(b)) & np.uint64(1)).T
            planes[:, b] = np.packbits(digit, axis=1, bitorder="little").view(np.uint64)
        return pd.DataFrame([{
            "block": key[0], "n": len(frame), "dims": width, "bits": bits, "low": low,
            "ids": frame["id"].to_numpy(np.int64).tobytes(), "planes": planes.tobytes()}])

    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInPandas(
        build, "block long, n long, dims int, bits int, low long, ids binary, planes binary")


def _add(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Adds bitmaps (``columns[p]``: those that weigh 2 ** p, a row each): the digits of the sums."""
    digits, p = [], 0
    columns = list(columns)
    while p < len(columns):
        here = columns[p]
        while len(here) > 1:
            m, pair = len(here) // 3, len(here) == 2
            if pair:
                a, b = here[:1], here[1:]
                here, carry = a ^ b, a & b
            else:
                a, b, c = here[:m], here[m:2 * m], here[2 * m:3 * m]
                half = a ^ b
                carry = (a & b) | (half & c)
                here = np.concatenate([half ^ c, here[3 * m:]])
            if p + 1 == len(columns):
                columns.append(carry)
            else:
                columns[p + 1] = np.concatenate([columns[p + 1], carry])
        digits.append(here[0] if len(here) else None)
        p += 1
    return digits


def block_scores(planes: np.ndarray, query: np.ndarray, low: int) -> tuple[list[np.ndarray], int]:
    """The digits of (score - base) of every row, and base. A negative component adds the
    complements of the attribute's planes, so that all terms count upward."""
    dims, bits, words = planes.shape
    query = query[:dims]
    columns: list[list[np.ndarray]] = []
    size = np.abs(query)
    top = (1 << bits) - 1
    # Sums of large components exceed a long.
    base = int(low) * sum(query.tolist()) - top * sum(size[query < 0].tolist())
    for t in range(int(size.max()).bit_length() if len(size) else 0):
        on = np.flatnonzero((size >> t) & 1)
        if not len(on):
            continue
        part = planes[on]
        negative = query[on] < 0
        part[negative] = ~part[negative]
        while len(columns) < t + bits:
            columns.append([])
        for b in range(bits):
            columns[t + b].append(part[:, b])
    none = np.zeros((0, words), np.uint64)
    digits = _add([np.concatenate(c) if c else none for c in columns])
    return [d if d is not None else np.zeros(words, np.uint64) for d in digits], base


def top_rows(digits: list[np.ndarray], taking_part: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """The places of the ``k`` best rows; at the boundary the smallest ids win."""
    sure, open_rows, left = np.zeros_like(taking_part), taking_part, k
    for d in reversed(digits):
        ones = open_rows & d
        n = int(np.bitwise_count(ones).sum())
        if n >= left:
            open_rows = ones
        else:
            sure, left, open_rows = sure | ones, left - n, open_rows & ~d
    places = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    edge = places(open_rows)
    edge = edge[np.argsort(ids[edge], kind="stable")][:left]
    return np.concatenate([places(sure), edge])


def score_of(digits: list[np.ndarray], place: int, base: int) -> int:
    word, bit = divmod(place, 64)
    return base + sum(((int(d[word]) >> bit) & 1) << p for p, d in enumerate(digits))


def top_k(index: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` best rows of the index for each query (id, x): query_id, rank, vec_id, score.

    A row with the query's own id is not among them; with fewer others all are
    returned. Ties go to the smaller id. Vectors of different length meet in their
    common components. An empty index or query set gives no rows. Rows are ranked by their
    exact scores; a score beyond the range of a long is returned as the nearest long.
    """
    last = index.agg(F.max("block")).first()[0] or 0
    parts = max(1, -(-queries.count() // query_rows))
    each = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(parts)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            r = left.iloc[0]
            ids = np.frombuffer(r["ids"], np.int64)
            planes = np.frombuffer(r["planes"], np.uint64).reshape(r["dims"], r["bits"], -(-len(ids) // 64))
            everyone = np.packbits(np.arange(planes.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
            for qid, x in zip(right["id"].tolist(), right["x"]):
                digits, base = block_scores(planes, np.asarray(x, np.int64), r["low"])
                taking_part = everyone.copy()
                at = int(np.searchsorted(ids, qid))
                while at < len(ids) and ids[at] == qid:
                    taking_part[at // 64] &= ~np.uint64(1 << (at % 64))
                    at += 1
                for p in top_rows(digits, taking_part, k, ids):
                    score = score_of(digits, int(p), base)
                    out.append((qid, int(ids[p]), score >> LOW_DIGITS, score & ((1 << LOW_DIGITS) - 1)))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "high", "low"])

    found = each.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(
        meet, "query_id long, vec_id long, high long, low long")
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    score = F.when(F.col("high") < -2, F.lit(-(1 << 63))).when(F.col("high") > 1, F.lit((1 << 63) - 1)).otherwise(
        F.shiftleft("high", LOW_DIGITS) + F.col("low")).alias("score")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", score)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
