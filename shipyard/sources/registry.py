"""A stored registry (version or client registry): replace by key, touched partitions only.

The rows lie in partitions by the hash of their key. An update reads and replaces the
partitions its keys fall into; all others keep their files. Spark's own writer replaces them
(dynamic partition overwrite). The new content is written to the checkpoint folder first, so nothing
that is read is being overwritten, and an update that fails half-way gives the same result when
it is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.outcomes import replace_by_key
from ..operators.tables import materialize_table

PART = "key_part"


def _part(key: Sequence[str], partitions: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(partitions)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def create_registry(rows: DataFrame, path: str, key: Sequence[str], partitions: int = 64) -> None:
    """Stores a registry. Every later call takes the same ``key`` and ``partitions``."""
    _write(rows.withColumn(PART, _part(key, partitions)), path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def update_registry(spark: SparkSession, updates: DataFrame, path: str, key: Sequence[str],
                    update_order: Sequence[str], partitions: int = 64, registries: DataFrame | None = None) -> list[int]:
    """Deletes the rows of the updated keys and inserts the updates, the last one per key; returns the partitions replaced.

    ``registries`` (some of the key's columns and registry_exists, A5): only where the registry exists.
    The list of touched partitions (at most ``partitions`` numbers) is all that the driver sees.
    """
    if registries is not None:
        where = [c for c in registries.columns if c != "registry_exists"]
        updates = updates.join(registries.where("registry_exists").select(*where).distinct(), where, "left_semi")
    updates = materialize_table(updates.withColumn(PART, _part(key, partitions)))
    touched = sorted(r[0] for r in updates.select(PART).distinct().collect())
    if not touched:
        return []
    stored = spark.read.parquet(path).where(F.col(PART).isin(touched))
    columns = stored.columns
    new = replace_by_key(stored, updates, [*key, PART], update_order=update_order).drop("origin")
    _write(materialize_table(new.select(*columns)), path)
    return touched
