"""The corpus pipeline: from raw documents to token ids in five stages.

Each stage works on all that the stage before it kept. Its result is written as Parquet to the shared
folder and read again, so a lost executor costs tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.llm.bpe import decode_tokens, encode_documents
from farsight.llm.common import prepare, stage
from farsight.llm.decontaminate import drop_contaminated
from farsight.llm.near_dup import drop_near_duplicates
from farsight.llm.quality import keep_good
from farsight.llm.registry import QUERIES
from farsight.llm.secrets import mask_secrets, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and every quality rule; null and empty texts go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 80 %): the one of the least id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` that of the new text."""
    masked = mask_secrets(docs, train(docs))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether they decode to the text: doc_id, n_tokens, token_ids, exact."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_documents(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ranks)
    # Written in between, so that a task needs one Python worker at a time, not two.
    decoded = decode_tokens(stage(encoded, "pipeline-encoded"), ranks)
    return decoded.select("doc_id", "n_tokens", "token_ids", (F.col("decoded") == F.col("text").cast("binary")).alias("exact"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

# Markov scores and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
