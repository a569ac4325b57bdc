"""Documents to training tokens: reject poor texts, keep one of each near copy, drop
what leaks benchmark items, mask secrets, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
run() writes each stage's result to the shared folder and reads it again.

Defined cases, of every stage: other columns are carried, under any name, but by the last;
an empty table gives an empty table. Null and empty texts are scored like any text by
quality, have no copies, no benchmark windows, no secrets and no tokens. Rows with a null
id stay rows of their own; rows that repeat an id are one document, of which near_copies
keeps the first. Texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hopweave.llm import byte_bpe, decontaminate, near_dup, quality_model, secrets
from hopweave.llm.labelled import remainder
from hopweave.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; ties in score are accepted alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.keep_good(docs, quality_model.learn(docs, labels, remainder("doc_id", 5) != 0))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id, and all rows with a null id."""
    return near_dup.drop_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; all of them if the benchmark is empty."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; a null text stays null."""
    return secrets.redact(docs, secrets.learn(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes; no tokens for a null text."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("masked", masked), ("tokens", tokens)]

#: Trained models and signatures are not SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
