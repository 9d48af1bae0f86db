"""Slots of a table in which one row, and one null key with many texts, have most of the rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import shards


@pytest.mark.parametrize("chunk", [4096, 7])
def test_slots_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(shards, "CHUNK", chunk)
    key = F.when(F.col("id") < 1000, 5).when(F.col("id") >= 2000, F.col("id")).cast("long")
    text = F.when(F.col("id") < 1000, "same").otherwise(F.concat(F.lit("text "), (F.col("id") % 300).cast("string")))
    docs = spark.range(2500).select(key.alias("doc_id"), text.alias("text"))
    found = shards.assign(docs, [1.0, 1.0]).collect()

    def order(doc_id, size, crc):
        name = "null" if doc_id is None else str(doc_id)
        return hashlib.md5(name.encode()).hexdigest()[: shards.BUCKET_DIGITS], doc_id is not None, doc_id or 0, crc, size

    want = sorted(order(r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert sorted(order(r.doc_id, r.size, r.text_crc32) for r in found) == want
    for shard in (0, 1):
        mine = sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        places = [order(r.doc_id, r.size, r.text_crc32) for r in mine]
        assert places == sorted(places)
