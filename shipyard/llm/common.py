"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import materialize_table

__all__ = ["arrow_rows", "fold", "materialize_table", "read_table", "row_slices"]

#: Text bytes that a Python worker handles at a time (one longer text is taken alone).
BLOCK_BYTES = 4 << 20
#: Rows that it handles at a time.
BLOCK_ROWS = 2048


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def row_slices(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES,
               block_rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of up to ``block_rows`` rows whose ``column`` holds up to ``block_bytes``."""
    if not batch.num_rows:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    low, size = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > low and (size + n > block_bytes or k - low >= block_rows):
            yield batch.slice(low, k - low)
            low, size = k, 0
        size += n
    yield batch.slice(low)


def arrow_rows(batches: Iterable[pa.RecordBatch], column: str, block_bytes: int = BLOCK_BYTES,
               block_rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from row_slices(batch, column, block_bytes, block_rows)
