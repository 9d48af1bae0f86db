"""Idempotent ingestion of relay objects, in batch and as a stream.

Sidecars have key, group, seq, fp, epoch, token, replaces, media (whether its photo is there) and n, their order. State
is a log of what each batch decided, partitioned by batch: the newest entry of a key counts, a batch that runs again
after a failure reads the log below it and overwrites its own part, so every effect happens once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.filters import is_safe_group
from quire.streaming import state as state_log

STATE = "key string, fp string, dead boolean"


def decide(sidecars: DataFrame, state: DataFrame, epoch: str, token: str) -> DataFrame:
    """key, fp and action: quarantine, foreign, wait, skip, ingest or dead, of the last sidecar of each key.

    Keys that a sidecar replaces, or that the state has as dead, are dead; a known fingerprint is skipped, another is
    ingested again; a sidecar without its photo waits.
    """
    safe = sidecars.withColumn("safe", is_safe_group(F.col("group")))
    names = ("fp", "epoch", "token", "replaces", "media", "safe")
    last = safe.groupBy("key").agg(F.max_by(F.struct(*names), "n").alias("s")).select("key", *(F.col(f"s.{c}").alias(c) for c in names))
    mine = last.where((F.col("epoch") == epoch) & (F.col("token") == token) & F.col("safe"))
    replaced = mine.where("replaces IS NOT NULL").select(F.col("replaces").alias("key"), F.lit(True).alias("replaced")).distinct()
    known = state.groupBy("key").agg(F.max_by(F.struct("fp", "dead"), "batch").alias("k")).select("key", F.col("k.fp").alias("known_fp"), F.col("k.dead").alias("dead"))
    met = last.join(known, "key", "left").join(replaced, "key", "left")
    action = (
        F.when(~F.col("safe"), "quarantine")
        .when((F.col("epoch") != epoch) | (F.col("token") != token), "foreign")
        .when(F.coalesce("replaced", F.lit(False)) | F.coalesce("dead", F.lit(False)), "dead")
        .when(~F.col("media"), "wait")
        .when(F.col("known_fp") == F.col("fp"), "skip")
        .otherwise("ingest")
    )
    return met.select("key", "fp", action.alias("action"))


def ready_controls(controls: DataFrame, processed: DataFrame) -> DataFrame:
    """Segment controls (group, seqs) with ready: every listed seq of the group is processed (group, seq). None listed: ready."""
    listed = controls.select("group", F.explode_outer("seqs").alias("seq"))
    met = listed.join(processed.select("group", "seq", F.lit(True).alias("done")).distinct(), ["group", "seq"], "left")
    return met.groupBy("group").agg((F.count_if(F.col("seq").isNotNull() & F.col("done").isNull()) == 0).alias("ready"), F.count_if(F.col("seq").isNotNull() & F.col("done").isNull()).alias("n_missing"))


def session_complete(controls: DataFrame, processed: DataFrame, waiting: DataFrame) -> DataFrame:
    """One row: a session ends once no photo waits and no segment is deferred."""
    deferred = ready_controls(controls, processed).agg(F.count_if(~F.col("ready")).alias("n_deferred"))
    return deferred.join(F.broadcast(waiting.agg(F.count(F.lit(1)).alias("n_waiting"))), F.lit(True)).select("n_deferred", "n_waiting", ((F.col("n_deferred") == 0) & (F.col("n_waiting") == 0)).alias("complete"))


def orphans(objects: DataFrame, now: str | Column, minutes: int = 10) -> DataFrame:
    """Old objects (stem, kind, modified) that miss their partner, with the reason; drained: a receipt with neither left."""
    kinds = objects.groupBy("stem").agg(F.max(F.col("kind") == "photo").alias("has_photo"), F.max(F.col("kind") == "media").alias("has_media"))
    old = objects.where(F.col("modified") < (now if isinstance(now, Column) else F.to_timestamp(F.lit(now))) - F.make_interval(mins=F.lit(minutes)))
    met = old.join(kinds, "stem")
    reason = F.when((F.col("kind") == "media") & ~F.col("has_photo"), "no_sidecar").when((F.col("kind") == "photo") & ~F.col("has_media"), "no_media").when((F.col("kind") == "receipt") & ~F.col("has_photo") & ~F.col("has_media"), "drained")
    return met.select("stem", "kind", reason.alias("reason")).where("reason IS NOT NULL")


def start(spark: SparkSession, sidecars: DataFrame, state_path: str, out_path: str, checkpoint: str, epoch: str, token: str):
    """A query that decides each micro-batch of streaming sidecars, logs its state and appends what it ingests.

    Results and state are written before the batch is committed, each batch into a folder of its own that a rerun overwrites.
    """

    def step(batch: DataFrame, log: DataFrame):
        decided = decide(batch, log, epoch, token)
        new = decided.where("action IN ('ingest', 'dead')").select("key", "fp", (F.col("action") == "dead").alias("dead"))
        newest = log.groupBy("key").agg(F.max_by(F.struct("fp", "dead"), "batch").alias("r")).select("key", "r.*")
        return new, newest.join(new, "key", "left_anti").unionByName(new), decided.where("action = 'ingest'").select("key", "fp")

    return state_log.run(sidecars, STATE, step, state_path, out_path, checkpoint)
