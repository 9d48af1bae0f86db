"""Sequences over hot groups: what chunks and carries give equals plain windows, and no task gets a group."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import chunks, ranking, sequence

SCHEMA = "shelf string, seq long, classification string, box string, text string, n int"


def pages(spark, seed=3):
    """Groups of 1 to 400 rows, a null one and one without boxes among them; seqs have gaps."""
    rng, rows = random.Random(seed), []
    for shelf, size in (("a", 400), ("b", 37), ("c", 1), (None, 90), ("d", 8), ("e", 16)):
        seqs = sorted(rng.sample(range(5000), size))
        for seq in seqs:
            kind = rng.choice(["Document Start", "Continuation", "Continuation", "Continuation", "Box", "Folder", None, "odd"])
            rows.append((shelf, seq, kind, rng.choice([None, None, None, f"Box {rng.randrange(4)}"]) if shelf != "d" else None, rng.choice([None, f"text {seq}" * 3]), rng.choice([None, 0, 1, 3])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


OPERATIONS = {
    "segments": lambda p: sequence.segments(p, "shelf"),
    "runs": lambda p: sequence.runs(p, "shelf"),
    "collections": lambda p: sequence.collections(p, "shelf", F.col("box")),
    "as_of_box": lambda p: sequence.as_of_box(p, "shelf", F.col("box"), F.col("text")),
    "previous_tail": lambda p: sequence.previous_tail(p, "shelf", n=7),
    "triage": lambda p: sequence.triage(p, "seq", F.col("classification") == "odd", "shelf"),
    "triage of all": lambda p: sequence.triage(p.dropDuplicates(["seq"]).orderBy("seq"), "seq", F.col("seq") % 5 == 1),
    "find_positions": lambda p: sequence.find_positions(p, "shelf", "seq", "n"),
    "selected_runs": lambda p: sequence.selected_runs(p.where("shelf IS NOT NULL"), "shelf", F.col("seq") % 9 == 4),
    "unique_names": lambda p: sequence.unique_names(p.select(F.coalesce("shelf", F.lit("a 2")).alias("name"), (F.col("seq") * 10 + F.length(F.coalesce("shelf", F.lit("")))).alias("seq")).dropDuplicates(["seq"]), "name", "seq"),
}


def rows_of(df):
    names = sorted(df.columns)
    return sorted(str([r[n] for n in names]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(OPERATIONS))
def test_hot_groups_equal_plain_windows(spark, monkeypatch, name):
    rows = pages(spark).withColumn("key_", F.lit(1))
    if name == "triage of all":
        rows = spark.createDataFrame(rows.collect(), rows.schema)
    plain = rows_of(OPERATIONS[name](rows))
    monkeypatch.setattr(ranking, "HOT_ROWS", 8)
    monkeypatch.setattr(ranking, "HOT_SHARE", 0)
    for size in (3, 16):
        monkeypatch.setattr(chunks, "CHUNK", size)
        assert rows_of(OPERATIONS[name](rows)) == plain, size
        if size == 16:
            monkeypatch.setattr(chunks, "MOST_BROADCAST", 0)


def test_segments_and_runs_equal_a_loop(spark):
    rows, state = sorted(pages(spark).collect(), key=lambda r: (r.shelf or "", r.seq)), {}
    want = {}
    for r in rows:
        segment, run, before = state.get(r.shelf, (-1, -1, "first"))
        segment += before in ("first", "Box", "Folder") or r.classification in ("Box", "Folder", None, "Document Start")
        run += before == "first" or r.classification != "Continuation"
        state[r.shelf], want[r.shelf, r.seq] = (segment, run, r.classification), (segment, run)
    got = {(r.shelf, r.seq): (r.segment, r.run) for r in sequence.runs(sequence.segments(pages(spark), "shelf"), "shelf").collect()}
    assert got == want


@pytest.mark.parametrize("size", [3, 4, 8192])
def test_neighbours_across_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(chunks, "CHUNK", size)
    table = spark.createDataFrame([(g, i, f"{g}{i}") for g, n in (("a", 30), ("b", 1), ("c", 7)) for i in range(n)], "shelf string, segment long, text string")
    got = {(r.shelf, r.segment): r.context for r in sequence.nearby(table, "shelf").collect()}
    sizes = {"a": 30, "b": 1, "c": 7}
    assert got == {(g, i): "\n---\n".join([f"{g}{j}" for j in [*range(max(0, i - 3), i), *range(i + 1, min(n, i + 4))]][:3]) for g, n in sizes.items() for i in range(n)}


@pytest.fixture
def sixteen_partitions(spark):
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_group_with_half_of_all_rows_is_spread(spark, sixteen_partitions):
    """A million pages, half of them of one shelf: no task of the last step has much over twice the mean of its rows."""
    kind = F.when(F.col("id") % 7 == 3, "Document Start").when(F.col("id") % 101 == 5, "Box").otherwise("Continuation")
    rows = spark.range(1_000_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("shelf"), F.col("id").alias("seq"), kind.alias("classification"))
    found = sequence.segments(rows, "shelf")
    hot = found.where("shelf = -1").agg(F.max("segment"), F.min("segment"), F.count_distinct("segment")).first()
    starts = rows.where("shelf = -1 AND (classification <> 'Continuation')").count()
    assert hot[1] == 0 and hot[0] + 1 == hot[2] >= starts
    per_task = [r.n for r in found.where("shelf = -1").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per_task) == 500_000 and len(per_task) >= 12 and max(per_task) <= 2.2 * 500_000 / 16
