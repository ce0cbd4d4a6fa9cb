"""Materialised intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

_scratch: list[list[tuple]] = []


@contextmanager
def scratch_tables() -> Iterator[None]:
    """Removes the tables that are written inside the block at its end.

    For jobs that write their results themselves (a stream's micro-batch, a test).
    """
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def materialize_table(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a parquet table under the session's shared
    checkpoint folder (``spark.checkpoint.dir``) and read it back.

    Re-reads are columnar (pruned, filters pushed down), a lost executor loses
    nothing, and every later reader sees the same rows, even when ``df`` holds
    values that depend on partitioning or row order.
    """
    from ..session import checkpoint_dir

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # a table without rows may have no file to ask
