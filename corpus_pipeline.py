"""The corpus pipeline: documents in, places in packed training sequences out.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run``
writes each result as Parquet under spark.checkpoint.dir and gives it to the next
stage. All but the last one return the columns of ``documents``.

1. quality: documents that the classifier rejects go;
2. exact: of equal texts one document stays;
3. near: of each class of near copies one document stays;
4. mix: sources are mixed to their targets (a document may stay up to 3 times);
5. pack: the documents are tokenised and packed into sequences: where each piece lies,
   with a checksum of its ids (``packing.sequences`` writes the ids themselves).

Null and empty texts are one text to the exact stage, of which one row stays if the
classifier keeps it; it has no words for the mix and one token for the pack. Rows that
repeat id and text are copies like others. Null ids and sources have no special
meaning: a row without an id is the last choice of the exact stage and stays in the near
stage, a null source is a source of its own. Columns beyond those of ``documents`` are carried along, whatever
their names, up to the pack. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shipyard.llm import exact_dedup, mixing, near_dedup, packing, quality, queries
from shipyard.llm.common import materialize_table, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, queries.quality_model(spark, docs, sf_dir), queries.THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_last(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage),
          ("pack", pack_stage)]

#: No SQL can express the classifier, the signatures or the tokenizer; the tests compare
#: each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize_table(stage(spark, docs, sf_dir))
    return docs
