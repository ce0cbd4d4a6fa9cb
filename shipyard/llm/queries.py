"""The operators bound to the shared tables, as ``opN_<name>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bitslice,
    bpe,
    chat_tree,
    exact_dedup,
    language,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    quality,
    suffix_dedup,
    toxicity,
    variants,
)
from .common import fold, materialize_table, read_table

#: A score from here on predicts the label.
THRESHOLD = 0.3


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(fold("doc_id", 3) != 1))
    found = language.identify(docs, model)
    return found.select(F.col("_doc").alias("doc_id"), (fold("_doc", 3) == 1).alias("held_out"), "lang_pred", "score",
                        "ambiguous")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


#: The conversation that the query adds: texts made of control strings.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return chat_tree.read_back(*chat_tree.build_tree(turns.unionByName(extra)))


def _scored(found: DataFrame, folds: int, held: int) -> DataFrame:
    return found.select(
        F.col("_doc").alias("doc_id"), (fold("_doc", folds) == held).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Linear:
    """Learns from the rows of both tables whose id is not 0 modulo 5."""
    learn = fold("doc_id", 5) != 0
    return quality.train(docs.where(learn), read_table(spark, sf_dir, "labels").where(learn))


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(quality.score(docs, quality_model(spark, docs, sf_dir)), 5, 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = fold("doc_id", 4) != 2
    model = toxicity.train(docs.where(learn), read_table(spark, sf_dir, "labels").where(learn), docs)
    return _scored(toxicity.score(docs, model), 4, 2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(read_table(spark, sf_dir, "documents"))


def op6_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize_table(bitslice.quantised(read_table(spark, sf_dir, "embeddings")))
    index = materialize_table(bitslice.build_index(rows))
    return bitslice.top_k(index, rows.where("id % 50 = 0"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(read_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_tree": op4_chat_tree,
    "op5_quality_pu": op5_quality_pu,
    "op6_bit_sliced_topk": op6_bit_sliced_topk,
    "op7_source_mixing": op7_source_mixing,
    "op8_near_dedup": op8_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_bpe": op13_bpe,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_bit_sliced_topk": bitslice.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
}
