"""Streams that correct or complete earlier batches, fed one file at a time."""

import datetime

import pytest
from pyspark.sql import functions as F

from quire.streaming import ingest, passes, state


@pytest.fixture
def feed(spark, tmp_path):
    """send(rows) appends a batch and runs the query; returns what that batch gave."""

    def make(schema, start):
        places = [str(tmp_path / x) for x in ("state", "out", "check")]
        n = iter(range(1000))

        def send(*rows):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
            start(spark.readStream.schema(schema).parquet(str(tmp_path / "feed")), *places).awaitTermination()
            return sorted(map(tuple, spark.read.parquet(f"{places[1]}/batch={next(n)}").collect()))

        return send

    return make


@pytest.mark.parametrize("every", [1, 20])
def test_deletes_need_two_passes_in_a_row(spark, feed, monkeypatch, every):
    monkeypatch.setattr(state, "COMPACT", every)
    indexed = spark.createDataFrame([(i,) for i in range(1, 5)], "k int")
    send = feed("k int", lambda s, *p: passes.confirm_deletes(s, indexed, "k", *p))
    assert send((1,), (2,)) == [] and send() == [] and send((1,), (2,), (4,)) == [(3,)]
    assert send((1,)) == [] and send((1,), (4,)) == [(2,)] and send((1,), (4,)) == []


@pytest.mark.parametrize("every", [1, 20])
def test_controls_wait_for_their_pages(feed, monkeypatch, every):
    monkeypatch.setattr(state, "COMPACT", every)
    send = feed("group string, seq int, seqs array<int>", passes.release_controls)
    assert send(("a", None, [1, 2]), ("a", 1, None), ("b", None, [])) == [("b",)]
    assert send(("c", 7, None)) == [] and send(("a", 2, None), ("c", None, [7])) == [("a",), ("c",)]
    assert send(("a", 2, None)) == []


def test_orphans_come_out_once_they_are_old(feed):
    t = lambda m: datetime.datetime(2026, 1, 1, 12, m)
    send = feed("stem string, kind string, modified timestamp", lambda s, *p: passes.sweep_orphans(s, F.to_timestamp(F.lit("2026-01-01 12:30:00")), *p))
    assert send(("x", "media", t(1)), ("y", "photo", t(25)), ("z", "photo", t(2))) == [("x", "media", "no_sidecar"), ("z", "photo", "no_media")]
    assert send(("z", "media", t(3)), ("w", "receipt", t(1))) == [("w", "receipt", "drained")]


@pytest.mark.parametrize("every", [1, 20])
def test_late_boxes_pin_pages_again(feed, monkeypatch, every):
    monkeypatch.setattr(state, "COMPACT", every)
    send = feed("group string, seq long, box string, current string", passes.pin_boxes)
    assert send(("g", 2, None, "k"), ("g", 5, None, "k"), ("h", 1, None, "k")) == [("g", 2, "k"), ("g", 5, "k"), ("h", 1, "k")]
    assert send(("g", 4, "B", "k")) == [("g", 4, "k"), ("g", 5, "B")]
    assert send(("g", 1, "A", "k")) == [("g", 1, "k"), ("g", 2, "A")]
    assert send(("h", 9, None, "k")) == [("h", 9, "k")]


def test_compacted_ingest_state_decides_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "COMPACT", 2)
    schema = "key string, `group` string, fp string, epoch string, token string, replaces string, media boolean, n long"
    feed, places = str(tmp_path / "feed"), [str(tmp_path / x) for x in ("state", "out", "check")]
    for n, fp in enumerate("aabba"):
        spark.createDataFrame([("g__1", "g", fp, "now", "t", None, True, n), (f"g__{n + 2}", "g", "x", "now", "t", None, True, n)], schema).coalesce(1).write.mode("append").parquet(feed)
        ingest.start(spark, spark.readStream.schema(schema).parquet(feed), *places, "now", "t").awaitTermination()
    got = spark.read.option("basePath", places[1]).parquet(f"{places[1]}/batch=*").where("key = 'g__1'").orderBy("batch").collect()
    assert [(r.fp, r.batch) for r in got] == [("a", 0), ("b", 2), ("a", 4)]
    assert state.entries(spark, places[0], ingest.STATE, 4).agg(F.min("batch")).first()[0] == 3


def test_a_stream_goes_on_at_an_interval(spark, tmp_path):
    """One query takes batches as they come, gives what single runs give and lets go of them; one that fails lets go too."""
    schema, places = "group string, seq int, seqs array<int>", [str(tmp_path / x) for x in ("state", "out", "check")]

    def add(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))

    add(("a", None, [1, 2]), ("a", 1, None))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    query = passes.release_controls(source, *places, interval="100 milliseconds")
    try:
        query.processAllAvailable()
        add(("a", 2, None))
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert [spark.read.parquet(f"{places[1]}/batch={n}").count() for n in (0, 1)] == [0, 1]

    def fails(batch, log):
        batch.count()
        raise ValueError("no step")

    with pytest.raises(Exception, match="no step"):
        state.run(source, "k int", fails, *(p + "2" for p in places)).awaitTermination()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= kept
