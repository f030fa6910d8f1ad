"""The corpus pipeline: quality, near-copies, repeated passages, test items, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it kept. run() writes what a stage returns
as Parquet to the shared folder and reads it again for the next.

In every stage null texts are empty, long texts are worked on whole, repeated rows are rows of their own (near-copies of each other,
of which one stays), extra columns are kept as they are, and an empty table gives an empty table. Of near-copies with one doc_id,
or without, one stays all the same. Labels and test items that are null or missing take no part.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.bpe import decode_documents, encode_documents, free_name
from waymark.llm.common import new_folder
from waymark.llm.decontaminate import decontaminate
from waymark.llm.quality import reject_low_quality
from waymark.llm.simhash import near_dedup
from waymark.llm.substring import remove_repeats


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    return reject_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-copies (five-word shingles, similarity 0.8)."""
    return near_dedup(docs, k=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur twice or more (windows of 35 words)."""
    return remove_repeats(docs, window=35, length_col="n_chars" if "n_chars" in docs.columns else None)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every test item's five-word shingles."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, similarity=0.8)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, all columns, with their token ids (little-endian unsigned 32-bit), their number, and the text decoded from
    them. An input column called ids, n_tokens or decoded stays; the new one's name then gets a number."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    coded = decode_documents(encode_documents(docs, *path), *path, ids_col=ids)
    out = coded.withColumn(free_name(docs, "n_tokens"), (F.length(f"`{ids}`") / 4).cast("long"))
    return out.withColumn(decoded, F.col(f"`{decoded}`").cast("string"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_test_items),
    ("byte-level BPE", tokenize),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
