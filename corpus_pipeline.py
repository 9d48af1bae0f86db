"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's docs.

Null texts count as empty and, like every text of under ten words, go in the first stage; null ids and sources, repeated
rows, very long texts and further columns go through all stages; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, lines, mixing, near, queries, rules
from quire.llm.text import small_batches
from quire.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three-line windows show to be repeats go, and documents left without a word."""
    return lines.keep_rest(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more) stays."""
    small_batches(spark)
    return near.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights, each at most twice; every document is there once at least."""
    return mixing.mix(docs, max_repeats=2.0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every remaining text."""
    small_batches(spark)
    return bpe.encode(docs, queries.tokenizer_path(), with_ids=True, carry=("lang", "source"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing sources", mixture), ("tokens", tokens)]
#: SQL cannot express the groups of near copies and the encoder; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
