"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .bpe import round_trip
from .decontaminate import LEAKS_SQL, find_leaks
from .ngram_lm import score_texts
from .pfor import token_digest
from .quality import score_quality
from .sharding import shard_documents
from .simhash import simhash_components
from .substring import KEPT_SQL, kept_digest
from .toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), k=3, radius=2)


def op2_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digest(_table(spark, sf_dir, "documents"), window=35)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return round_trip(_table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), order=3, pruned=True)


def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op9_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return token_digest(_table(spark, sf_dir, "documents"), p.path("word_bpe_49k.json"), end=1)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_vptree,
        op2_substring_rlz,
        op3_byte_bpe,
        op4_kneser_ney,
        op5_minhash_containment,
        op6_label_propagation,
        op7_toxicity_ftrl,
        op8_multi_index_hashing,
        op9_quality_rff,
        op10_pfor_tokens,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_substring_rlz": KEPT_SQL, "op5_minhash_containment": LEAKS_SQL.replace("{docs}", "documents")}
