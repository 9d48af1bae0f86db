"""Streams whose batches correct or complete earlier ones: deletes in two passes, deferred controls, orphans and late boxes.

Each ends when it has read what is there; with an interval such as "30 seconds", it goes on until it is stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.merge import confirm_absent
from quire.operators.sequence import as_of_box
from quire.streaming import ingest, state


def confirm_deletes(listings: DataFrame, indexed: DataFrame, key: str, *places: str, interval: str | None = None):
    """Each batch is the listing of one settled pass. Keys of indexed that two passes in a row lack come out once as deleted.

    An empty listing confirms nothing and leaves what was pending as it was. places: state, results, checkpoint.
    """
    schema = f"k {indexed.schema[key].dataType.simpleString()}, what string"

    def step(batch: DataFrame, log: DataFrame):
        newest = log.agg(F.max("batch")).first()[0]
        gone = log.where("what = 'deleted'").select(F.col("k").alias(key)).distinct()
        pending = log.where((F.col("what") == "pending") & (F.col("batch") == F.lit(newest))).select(F.col("k").alias(key))
        if batch.isEmpty():
            states = pending.select(key, F.lit("pending").alias("state"))
        else:
            states = confirm_absent(indexed.join(gone, key, "left_anti"), batch.select(key), pending, key)
        new = states.select(F.col(key).alias("k"), F.when(F.col("state") == "delete", "deleted").otherwise("pending").alias("what"))
        return new, new.unionByName(gone.select(F.col(key).alias("k"), F.lit("deleted").alias("what"))), states.where("state = 'delete'").select(key)

    return state.run(listings, schema, step, *places, interval=interval)


def release_controls(events: DataFrame, *places: str, interval: str | None = None):
    """Events are processed pages (group, seq) or controls (group, seqs). A control comes out once, in the first batch by which all its pages are there."""
    schema = "group string, seq int, seqs array<int>, released boolean"

    def step(batch: DataFrame, log: DataFrame):
        new = batch.select("group", "seq", "seqs", F.lit(False).alias("released"))
        every = log.drop("batch").unionByName(new)
        waiting = every.where("seqs IS NOT NULL").join(every.where("released").select("group"), "group", "left_anti").groupBy("group").agg(F.array_distinct(F.flatten(F.collect_list("seqs"))).alias("seqs"))
        ready = ingest.ready_controls(waiting, every.where("seq IS NOT NULL")).where("ready").select("group")
        done = ready.select("group", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("array<int>").alias("seqs"), F.lit(True).alias("released"))
        return new.unionByName(done), every.unionByName(done).distinct(), ready

    return state.run(events, schema, step, *places, interval=interval)


def sweep_orphans(objects: DataFrame, now: Column, *places: str, minutes: int = 10, interval: str | None = None):
    """Objects (stem, kind, modified) that are old at the time of a batch and still miss their partner come out once, with the reason."""
    schema = "stem string, kind string, modified timestamp, swept boolean"

    def step(batch: DataFrame, log: DataFrame):
        new = batch.select("stem", "kind", "modified", F.lit(False).alias("swept"))
        every = log.drop("batch").unionByName(new)
        known = every.groupBy("stem", "kind").agg(F.max("modified").alias("modified"), F.max("swept").alias("swept"))
        late = ingest.orphans(known.select("stem", "kind", "modified"), now, minutes).join(known.where("swept").select("stem", "kind"), ["stem", "kind"], "left_anti")
        done = late.select("stem", "kind", F.lit(None).cast("timestamp").alias("modified"), F.lit(True).alias("swept"))
        return new.unionByName(done), known.join(late.select("stem", "kind", F.lit(True).alias("late")), ["stem", "kind"], "left").select("stem", "kind", "modified", (F.col("swept") | F.coalesce("late", F.lit(False))).alias("swept")), late

    return state.run(objects, schema, step, *places, interval=interval)


def pin_boxes(pages: DataFrame, *places: str, interval: str | None = None):
    """Pages (group, seq, box, current). Whenever pages or boxes arrive, in any order, all pages of their groups whose box changed come out again.

    Of pages sent twice the later batch counts, so results are to be read newest batch first.
    """
    schema = "group string, seq long, box string, current string, assigned string"
    names = ["group", "seq", "box", "current"]

    def step(batch: DataFrame, log: DataFrame):
        touched = batch.select("group").distinct()
        newest = log.groupBy("group", "seq").agg(F.max_by(F.struct("box", "current", "assigned"), "batch").alias("r")).select("group", "seq", "r.*")
        fresh = batch.groupBy("group", "seq").agg(F.max(F.struct("box", "current")).alias("r")).select("group", "seq", "r.*")
        old = newest.join(touched, "group", "left_semi")
        now = fresh.unionByName(old.join(fresh, ["group", "seq"], "left_anti").select(names))
        pinned = as_of_box(now.withColumnRenamed("box", "named"), "group", F.col("named"), F.col("current")).select("group", "seq", F.col("named").alias("box"), "current", "assigned")
        before = old.select("group", "seq", F.col("assigned").alias("was"), F.lit(True).alias("known"))
        moved = pinned.join(before, ["group", "seq"], "left").where(F.col("known").isNull() | ~F.col("was").eqNullSafe(F.col("assigned"))).select(*names, "assigned")
        rest = newest.join(pinned, ["group", "seq"], "left_anti").select(*names, "assigned")
        return pinned, pinned.unionByName(rest), moved.select("group", "seq", "assigned")

    return state.run(pages, schema, step, *places, interval=interval)
