"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair gets a score -weight / ln(u), where u in (0, 1) is a hash of the pair, and a key goes to its
best shard. A new shard only takes the keys that it now scores best, and no other key moves; the share of a shard is
its share of the weights. Null keys share one key of their own; equal keys share a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import unit_hash, whole
from quire.session import cut

#: Hex digits of the MD5 that order a shard's rows for numbering.
BUCKET_DIGITS = 3
#: Copies of one row that are numbered at a time.
CHUNK = 4096


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def best_shard(key: Column, weights: list[float]) -> Column:
    """The shard of a key; ties go to the lowest number, weights of zero or less get no key."""
    scores = [
        F.struct((F.lit(-float(w)) / F.log(unit_hash(key_text(key), F.lit(str(i))))).alias("score"), F.lit(-i).alias("minus"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    if not scores:
        raise ValueError("a shard needs a weight above zero")
    best = F.array_max(F.array(*scores))
    return (-best["minus"]).cast("int")


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size is the UTF-8 length plus 1 (null text: 1, with the checksum of an empty text). Slots are gapless from 0 in
    each shard, in the order of a hash of the key, the key (null first), checksum and size. Rows alike in all of these are
    counted and numbered CHUNK at a time, and chunks are dealt to ranges of that order, so neither a shard nor a key, a null
    one or a repeated row among them, meets in one task. The sums of the ranges, one for each range and shard in it, are
    the offsets. Texts don't move; very long ones are only measured. An empty table gives no rows; other columns are not read.
    """
    own = F.col(key)
    bucket = F.substring(F.md5(key_text(own)), 1, BUCKET_DIGITS)
    grown = grown or [*weights, weights[-1]]
    body = whole(F.col(text))
    rows = docs.select(
        own.alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        best_shard(own, weights).alias("shard"),
        best_shard(own, grown).alias("grown_shard"),
        bucket.alias("bucket"),
    )
    order = ["bucket", "doc_id", "text_crc32", "size", "start"]
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))
    chunks = counted.withColumn("start", starts).withColumn("held", F.least(F.lit(CHUNK), F.col("n") - F.col("start"))).drop("n")
    dealt = cut(chunks.repartitionByRange("shard", *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("shard", "part").agg(F.sum("held").alias("held"))
    offsets = sums.select("shard", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("before", F.coalesce(F.sum("held").over(within), F.lit(0))).join(F.broadcast(offsets), ["shard", "part"])
    return placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("before") + F.col("nth")).alias("slot"), "grown_shard"
    )
