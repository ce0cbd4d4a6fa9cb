"""Keyed building blocks shared by the operators.

``first_by`` replaces ``row_number() over (partition by k order by o) = 1``.
It is an aggregate of ``min(struct(order..., row))``, so Spark combines it
map-side: a key that holds a third of all rows leaves each map task as a single
row, and no task ever sorts a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = str | Column


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike],
             last: bool = False) -> DataFrame:
    """One row per ``keys``: the row that sorts first by ``order`` (or last).

    Ordering is ascending with NULLs first (Spark's struct ordering); ``last=True``
    picks the greatest, i.e. descending with NULLs last. Ties on ``order`` are
    broken by the remaining columns, so the pick is deterministic.
    """
    # Plain order columns travel once, as order fields; the payload holds the rest.
    named = {c: i for i, c in enumerate(order) if isinstance(c, str)}
    rest = [c for c in df.columns if c not in keys and c not in named]
    packed = F.struct(
        *[_col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.struct(*rest).alias("_row"),
    )
    pick = (F.max(packed) if last else F.min(packed)).alias("_pick")
    return df.groupBy(*keys).agg(pick).select(
        *keys, *[F.col(f"_pick._o{i}").alias(c) for c, i in named.items() if c not in keys], "_pick._row.*")


def first_value_by(keys: Sequence[str], value: ColumnLike, order: Sequence[ColumnLike],
                   last: bool = False) -> Column:
    """Aggregate expression: ``value`` of the first (or last) row by ``order``."""
    packed = F.struct(*[_col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      _col(value).alias("_v"))
    return (F.max(packed) if last else F.min(packed)).getField("_v")


def explode_literal(rows: Sequence[tuple], names: Sequence[str]) -> Column:
    """A column that explodes a fixed list of rows onto every input row.

    Used instead of a cross join with a tiny rule table: the rules travel inside
    the plan as literals, so no join and no broadcast is needed.
    """
    return F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows
    ]))
