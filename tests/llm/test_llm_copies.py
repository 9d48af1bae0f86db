"""Copies of one row that hold half of a table, null ids among them."""

import pytest
from pyspark.sql import functions as F

from quire.llm import joins, near, simhash


@pytest.fixture
def table(spark):
    """Of 4,000 rows 1,000 are one row, 1,000 one with a null id; of the others each row is there once or twice."""
    word = F.sha2(F.concat(F.lit("w"), F.col("id").cast("string")), 256)
    text = F.when(F.col("id") < 2000, "the text of a hot row").otherwise(F.concat_ws(" ", word, F.reverse(word)))
    key = F.when(F.col("id") < 1000, -5).when(F.col("id") >= 2000, F.col("id"))
    rows = spark.range(3500).select(key.cast("long").alias("doc_id"), text.alias("text"), F.lit("x").alias("k"), F.lit(1).alias("row"))
    return rows.unionByName(rows.where("doc_id >= 3000"))


@pytest.mark.parametrize("hot_rows", [10_000, 100, 2])
@pytest.mark.parametrize("keep_first", [near.keep_first, simhash.keep_first])
def test_one_of_each_copy_stays(table, monkeypatch, hot_rows, keep_first):
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    kept = keep_first(table)
    found = kept.collect()
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in found) == [-5, *range(2000, 3500)]
    assert all(len(r.text.split()) == (6 if r.doc_id == -5 else 2) and r.k == "x" and r.row == 1 for r in found)
