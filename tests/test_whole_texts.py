"""Scalar queries without SQL use texts to their end."""

import re

from quire.plans import registry


def made(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_clean_copied_keeps_all_of_a_text(spark, tmp_path):
    texts = ["short", "word and-such\n" * 500, "z" * 300]
    got = {r.doc_id: r.cleaned for r in registry.QUERIES["fn14_clean_copied"](spark, made(spark, tmp_path, texts)).collect()}
    assert {d: re.sub(r"[\s-]", "", t) for d, t in got.items()} == {d: re.sub(r"[\s-]", "", t) for d, t in enumerate(texts)}


def test_title_sees_links_that_end_late(spark, tmp_path):
    texts = ["x" * 35 + " [" + "label " * 20 + "](http://y) end", "x" * 35 + " short"]
    got = {r.doc_id: r.title for r in registry.QUERIES["fn24_extract_title"](spark, made(spark, tmp_path, texts)).collect()}
    assert got == {0: "x" * 30 + " link xxxxx label label label…", 1: "x" * 30 + " link xxxxx short"}
