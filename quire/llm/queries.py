"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import boosted, bpe, chats, exponion, lines, mixing, oracles, pages, repair, rules, secret_scan, shards, simhash, sketches
from quire.llm.text import small_batches
from quire.session import cut, table

SHARDS = 8
#: The public tokenizer file that op4 encodes with.
TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(documents(spark, sf_dir), [1.0] * SHARDS)


def op2_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare(documents(spark, sf_dir))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = cut(documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("tokens")))
    mixed = mixing.mix(narrow, max_repeats=2.0, tokens=F.col("tokens"))
    return mixed.select("row.doc_id", "row.source", "tokens", F.col("pass").cast("long").alias("pass"), "block", "block_turn", "order_key")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer_path())


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measure(documents(spark, sf_dir))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(documents(spark, sf_dir)).select("row.doc_id", "n_lines", "n_removed", "text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first_id").alias("component_id"))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pages.main_text(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


#: A conversation whose texts hold the marks of op11's template.
MARKED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "conversations")


def op11_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text")
    return chats.read_back(chats.format_turns(rows.union(spark.createDataFrame(MARKED, rows.schema))))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(conversations(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_shards, op2_sketches, op3_mixture, op4_bpe, op5_rules, op6_lines, op7_simhash, op8_pages, op9_quality, op10_secrets, op11_chats, op12_clusters, op13_repair)}
ORACLES = oracles.SQL
