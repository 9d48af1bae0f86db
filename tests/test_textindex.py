"""The written index: entries made within rows, blocks that are skipped, rows that are not read, changes and odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import fulltext, textindex

WEIGHTS = {"body": 1.0, "name": 10.0}
SCHEMA = "id long, body string, name string"


def scanned(spark, table, since):
    """Rows that scans of a table of an index have given, in executions after a number of them."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    total, every = 0, store.executionsList()
    for i in range(every.size()):
        execution = every.apply(i).executionId()
        if execution <= since:
            continue
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if node.name().startswith("Scan parquet") and re.search(rf"Location: [^\]]*/{table}[/,\]]", node.desc()):
                metrics = node.metrics()
                for k in range(metrics.size()):
                    if metrics.apply(k).name() == "number of output rows" and values.contains(metrics.apply(k).accumulatorId()):
                        total += int(values.apply(metrics.apply(k).accumulatorId()).replace(",", ""))
    return total


def executions(spark):
    every = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((every.apply(i).executionId() for i in range(every.size())), default=-1)


def same(found, wanted):
    key = lambda r: (r["rank"], r["id"], round(r["score"], 9))
    assert sorted(map(key, found.collect())) == sorted(map(key, wanted.select("id", "rank", "score").collect()))


def generated(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 40))), f"name {rng.choice(words)}") for i in range(n)]


def test_entries_are_terms_with_their_places(spark):
    texts = ["b a b c a b", "", None, "Été été ETE x", "one", "a " * 5000 + "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", textindex.entries_of(F.col("t"), "t").alias("e")).collect()
    for i, e in rows:
        want = {}
        for at, w in enumerate(re.findall(r"[^\W_]+", fulltext.fold_word(texts[i] or ""))):
            want.setdefault(w, []).append(at)
        assert [(x["term"], x["c"], x["positions"]) for x in e] == [(w, "t", p) for w, p in sorted(want.items())]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK_BITS", 4)
    monkeypatch.setattr(textindex, "BLOCK", 16)


@pytest.mark.parametrize("query, limit", [("w0 w1", 7), ("name w40", 5), ("w5 w59", 1000), ("w0 missing", 5), ("w0-w1 w2", 5)])
def test_limited_searches_equal_whole_ones(spark, tmp_path, small_blocks, query, limit):
    df = spark.createDataFrame(generated(1500), SCHEMA).repartition(3, "id")
    path = str(tmp_path / "i")
    textindex.write_segment(df, WEIGHTS, "id", path, 0)
    same(textindex.search_index(spark, path, WEIGHTS, query, "id", limit=limit), fulltext.search(df, WEIGHTS, query, "id", limit=limit))
    some = textindex.search_index(spark, path, {"body": 1.0}, query, "id", limit=limit)
    same(some, textindex.search_index(spark, path, {"body": 1.0}, query, "id").where(f"rank <= {limit}"))


def test_blocks_that_cannot_reach_the_limit_are_not_read(spark, tmp_path, small_blocks):
    """Both words are in every text; a few texts in few blocks are full of them."""
    body = F.when(F.col("id") % 4000 < 6, F.lit("alpha beta " * 30)).otherwise(F.concat(F.lit("alpha beta "), F.repeat(F.lit("x "), 40)))
    df = spark.range(20_000, numPartitions=4).select("id", body.alias("body"), F.lit("n").alias("name"))
    path = str(tmp_path / "i")
    textindex.write_segment(df, WEIGHTS, "id", path, 0)
    index, read = textindex.Index(spark, path), []
    counts = textindex._counts
    textindex._counts = lambda index, blocks, *rest: (read.append(blocks.count()), counts(index, blocks, *rest))[1]
    try:
        found = textindex.search_index(spark, path, WEIGHTS, "alpha beta", "id", limit=20)
        ids = sorted(r["id"] for r in found.collect())
    finally:
        textindex._counts = counts
    assert ids == [i for i in range(20_000) if i % 4000 < 6][:20]
    every = index.blocks({("alpha", False)}).count()
    assert every >= 1250 and max(read) <= 80


def test_a_limited_search_reads_few_rows_and_moves_postings_only(spark, tmp_path):
    n = 60_000
    body = F.concat_ws(" ", F.concat(F.lit("word"), F.col("id") % 3000), F.concat(F.lit("also"), F.col("id") % 2000), F.lit("common"), F.repeat(F.lit("filler "), (F.col("id") % 7).cast("int")))
    df = spark.range(n, numPartitions=4).select("id", body.alias("body"), F.lit("n").alias("name"))
    path = str(tmp_path / "i")
    textindex.write_segment(df, WEIGHTS, "id", path, 0)
    since = executions(spark)
    found = textindex.search_index(spark, path, WEIGHTS, "word17 also17", "id", limit=50)
    assert sorted(r["id"] for r in found.collect()) == list(range(17, n, 6000))
    assert scanned(spark, "rows", since) < 0.05 * n
    assert scanned(spark, "postings", since) < 0.05 * spark.read.parquet(f"{path}/postings").count() * 4
    same(found, fulltext.search(df, WEIGHTS, "word17 also17", "id", limit=50))


def test_one_frequent_term_is_in_many_files(spark, tmp_path, small_blocks):
    df = spark.range(4000, numPartitions=4).select("id", F.lit("same").alias("body"), F.lit(None).cast("string").alias("name"))
    textindex.write_segment(df, WEIGHTS, "id", str(tmp_path / "i"), 0, files=4)
    sizes = [r["n"] for r in spark.read.parquet(str(tmp_path / "i" / "postings")).groupBy(F.input_file_name()).agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2000


def test_segments_replace_and_remove(spark, tmp_path, small_blocks):
    """Three segments, a document replaced twice, one removed and one put back; after each, all searches equal those of the rows themselves."""
    rows = {r[0]: r for r in generated(400)}
    path, rng = str(tmp_path / "i"), random.Random(2)
    textindex.write_segment(spark.createDataFrame(list(rows.values()), SCHEMA), WEIGHTS, "id", path, 0)
    for segment in (1, 2, 3):
        gone = rng.sample(sorted(rows), 40)
        changed = {i: (i, f"w0 w1 stale{segment}", "name w2") for i in [*rng.sample([k for k in rows if k not in gone], 40), 1000 + segment, 7 if segment != 2 else 8] if i not in gone}
        for i in gone:
            del rows[i]
        rows |= changed
        textindex.write_segment(spark.createDataFrame(list(changed.values()), SCHEMA), WEIGHTS, "id", path, segment, spark.createDataFrame([(i,) for i in [*gone, 99_999]], "id long"))
    df = spark.createDataFrame(list(rows.values()), SCHEMA)
    textindex.compact(spark, path, str(tmp_path / "c"))
    for folder in (path, str(tmp_path / "c")):
        for query, limit in (("w0 w1", None), ("w0 w1", 9), ("stale", 9), ("w0-w1 w", None), ("name w2", 5)):
            same(textindex.search_index(spark, folder, WEIGHTS, query, "id", limit=limit), fulltext.search(df, WEIGHTS, query, "id", limit=limit))


def test_odd_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    textindex.write_segment(none, WEIGHTS, "id", str(tmp_path / "e"), 0)
    assert textindex.search_index(spark, str(tmp_path / "e"), WEIGHTS, "word", "id").count() == 0
    df = spark.createDataFrame([(1, None, None), (2, "", "..."), (3, "long " * 30_000 + "end", "x"), (4, "end", None)], SCHEMA).withColumn("doc", F.lit(9)).withColumn("entries", F.lit("e"))
    textindex.write_segment(df, WEIGHTS, "id", str(tmp_path / "o"), 0)
    for query, limit in (("end", None), ("end", 1), ("long-long en", None), ("nothing", 3), (" ", None), ("!", 2)):
        same(textindex.search_index(spark, str(tmp_path / "o"), WEIGHTS, query, "id", limit=limit), fulltext.search(df, WEIGHTS, query, "id", limit=limit))


def test_search_with_and_without_kept_columns(spark):
    df = spark.createDataFrame(generated(200), SCHEMA)
    whole, narrow = fulltext.search(df, WEIGHTS, "w0 w1", "id"), fulltext.search(df, WEIGHTS, "w0 w1", "id", keep=())
    assert narrow.columns == ["id", "score", "rank"] and whole.columns == ["id", "body", "name", "score", "rank"]
    same(narrow, whole)


def test_what_moves_follows_blocks_and_files_follow_tokens(spark, tmp_path, monkeypatch):
    """A row for each term of a block moves, not one for each term of a document; files have near the same number of tokens."""
    monkeypatch.setattr(textindex, "FILE_TOKENS", 20_000)
    rows = generated(8000, seed=5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2, "id")
    path = str(tmp_path / "i")
    textindex.write_segment(df, WEIGHTS, "id", path, 0)
    assert spark.read.parquet(f"{path}/rows").columns == ["doc", "key", "n_tokens", "tokens", "segment"]
    held = spark.read.parquet(f"{path}/postings")
    assert held.count() < 60 * 2 * 12
    by_file = held.groupBy(F.input_file_name()).agg(F.sum(F.aggregate("held", F.lit(0), lambda n, h: n + F.size(h["positions"]))).alias("n")).collect()
    total = sum(len(b.split()) + len(n.split()) for _, b, n in rows)
    assert sum(r.n for r in by_file) == total and len(by_file) >= total // 20_000 - 1 and max(r.n for r in by_file) < 3 * 20_000
    for query, limit in (("w0 w1", 9), ("w0-w1 w2", None)):
        same(textindex.search_index(spark, path, WEIGHTS, query, "id", limit=limit), fulltext.search(df, WEIGHTS, query, "id", limit=limit))


def test_blocks_made_in_parts_answer_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "PART_TOKENS", 100)
    df = spark.createDataFrame(generated(700, seed=6), SCHEMA)
    path = str(tmp_path / "i")
    textindex.write_segment(df, WEIGHTS, "id", path, 0)
    textindex.write_segment(df.where("id % 3 = 0").withColumn("body", F.lit("w0 w1")), WEIGHTS, "id", path, 1)
    now = df.where("id % 3 <> 0").unionByName(df.where("id % 3 = 0").withColumn("body", F.lit("w0 w1")))
    monkeypatch.setattr(textindex, "MOST_GONE", 0)  # gone rows by shuffle
    textindex.compact(spark, path, str(tmp_path / "c"))
    for folder in (path, str(tmp_path / "c")):
        for query, limit in (("w0", 9), ("w0 w1", 9), ("w0-w1 w", None)):
            same(textindex.search_index(spark, folder, WEIGHTS, query, "id", limit=limit), fulltext.search(now, WEIGHTS, query, "id", limit=limit))


def test_ranges_of_files_are_found_without_a_sort_of_their_rows(spark, tmp_path):
    """A least and greatest text would be taken of rows sorted by file, all that a task reads."""
    path, since = str(tmp_path / "i"), executions(spark)
    textindex.write_segment(spark.createDataFrame(generated(900, seed=7), SCHEMA), WEIGHTS, "id", path, 0, files=5)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    every = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [every.apply(i).physicalPlanDescription() for i in range(every.size()) if every.apply(i).executionId() > since]
    assert plans and not any("SortAggregate" in p for p in plans)
    held = spark.read.parquet(f"{path}/postings/segment=0").groupBy(F.col("_metadata.file_name").alias("file"))
    made = held.agg(F.min("term").alias("first_term"), F.max("term").alias("last_term")).collect()
    assert len(made) > 3 and sorted(made) == sorted(spark.read.parquet(f"{path}/files").select("file", "first_term", "last_term").collect())


def shuffled(spark):
    """Bytes of shuffle files on this disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    every = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in every if f.getName().startswith("shuffle_"))


def size(spark, path):
    return sum(len(r["content"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("content").collect())


def test_an_index_holds_the_disk_of_its_postings_only(spark, tmp_path):
    """No tokens unless wanted, and neither writing nor compaction leaves shuffle files; the compacted index is the live rows' own, its documents dense."""
    spark.createDataFrame(generated(6000, seed=8), SCHEMA).repartition(3, "id").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    first, second, kept, before = str(tmp_path / "i"), str(tmp_path / "c"), str(tmp_path / "k"), shuffled(spark)
    textindex.write_segment(df.where("id % 2 = 0"), WEIGHTS, "id", first, 0, files=3, keep_tokens=False)
    textindex.write_segment(df.where("id % 2 = 1 OR id % 10 = 0"), WEIGHTS, "id", first, 1, files=3, keep_tokens=False)
    textindex.compact(spark, first, second, postings_per_file=100)
    assert shuffled(spark) - before < 0.25 * size(spark, f"{second}/postings")
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == sorted(textindex.TABLES)
    assert size(spark, f"{first}/rows") + size(spark, f"{second}/rows") < 0.5 * size(spark, f"{second}/postings")
    assert sorted(r["doc"] for r in spark.read.parquet(f"{second}/rows").collect()) == list(range(6000))
    textindex.write_segment(df, WEIGHTS, "id", kept, 0)
    figures = lambda path: sorted(map(tuple, spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n_docs"), F.sum("n_tokens"), F.sum(F.size("held"))).collect()))
    assert figures(second) == figures(kept) and spark.read.parquet(f"{second}/postings").groupBy("term", "block").count().where("count > 1").isEmpty()
    for query, limit in (("w0 w1", 9), ("w0-w1 w2", None)):
        same(textindex.search_index(spark, second, WEIGHTS, query, "id", limit=limit), fulltext.search(df, WEIGHTS, query, "id", limit=limit))


def test_small_batches_make_the_same_rows(spark, tmp_path, small_blocks):
    """Blocks are not cut where Arrow batches end."""
    df, name, found = spark.createDataFrame(generated(400, seed=9), SCHEMA).coalesce(1), "spark.sql.execution.arrow.maxRecordsPerBatch", []
    was = spark.conf.get(name)
    try:
        for k, n in enumerate((7, 10_000)):
            spark.conf.set(name, n)
            textindex.write_segment(df, WEIGHTS, "id", str(tmp_path / str(k)), 0)
            found.append(sorted(map(str, spark.read.parquet(str(tmp_path / str(k) / "postings")).collect())))
    finally:
        spark.conf.set(name, was)
    assert found[0] == found[1]
