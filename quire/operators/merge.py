"""Joins of snapshots, changes and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revalidate(cached: DataFrame, fresh: DataFrame, key: str, fingerprint: str, authoritative: bool) -> DataFrame:
    """Each key's action after a new pass: reuse a verified row with the same fingerprint, read it again, add, keep or drop.

    A key that the new pass lacks is dropped only if absence is authoritative.
    """
    old = cached.select(key, F.col(fingerprint).alias("old_print"), "verified", F.lit(True).alias("was"))
    new = fresh.select(key, F.col(fingerprint).alias("new_print"), F.lit(True).alias("is"))
    met = old.join(new, key, "full_outer")
    action = (
        F.when(F.col("is").isNull(), "drop" if authoritative else "keep")
        .when(F.col("was").isNull(), "add")
        .when(F.col("verified") & F.col("old_print").eqNullSafe(F.col("new_print")), "reuse")
        .otherwise("read")
    )
    return met.select(key, action.alias("action"))


def merge_snapshot(current: DataFrame, scanned: DataFrame, key: str, authoritative: bool) -> DataFrame:
    """The next snapshot: scanned rows win; absent rows stay unless their absence is authoritative."""
    return scanned if authoritative else scanned.unionByName(current.join(scanned, key, "left_anti"))


def upsert(current: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    return current.join(changed, key, "left_anti").unionByName(changed)


def overlay(rows: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """Rows (key, value, generation) under verified writes (key, value, seq, dropped): the last write applies if its seq is past the row's generation."""
    last = writes.groupBy(key).agg(F.max_by(F.struct("value", "dropped"), "seq").alias("w"), F.max("seq").alias("last_seq"))
    met = rows.join(last, key, "left")
    applies = F.coalesce(F.col("last_seq") > F.col("generation"), F.lit(False))
    return met.where(~(applies & F.col("w.dropped"))).select(key, F.when(applies, F.col("w.value")).otherwise(F.col("value")).alias("value"), applies.alias("overlaid"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(order, *[n for n in names if n != order])).alias("r")).select(*key, "r.*")


def skippable(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """inputs (path, base, mtime) with skip: their base name is theirs alone, whatever the case, and a newer output of it, another file, exists."""
    alone = F.count(F.lit(1)).over(Window.partitionBy(F.lower("base"))) == 1
    made = outputs.groupBy("base").agg(F.max_by(F.struct("output_path", "output_mtime"), "output_mtime").alias("o"))
    met = inputs.withColumn("alone", alone).join(made, "base", "left")
    newer = F.coalesce((F.col("o.output_path") != F.col("path")) & (F.col("mtime") <= F.col("o.output_mtime")), F.lit(False))
    return met.select("path", "base", (F.col("alone") & newer).alias("skip"))


def confirm_absent(indexed: DataFrame, current: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """key and state of indexed keys that the current pass lacks: delete if an earlier settled pass lacked them too, else pending.

    An empty current set confirms nothing: no row comes back, and the pending set is to be kept as it was.
    """
    some = current.limit(1).select(F.lit(True).alias("some"))
    absent = indexed.select(key).join(current, key, "left_anti").join(F.broadcast(some), F.lit(True), "left_semi")
    seen = pending.select(key, F.lit(True).alias("before"))
    return absent.join(seen, key, "left").select(key, F.when(F.col("before"), "delete").otherwise("pending").alias("state"))


def resolve_links(links: DataFrame, files: DataFrame, complete: Column | None = None) -> DataFrame:
    """link_id, state and path: the exact path, else the least path with that file name, else not found.

    Where the search was not complete, a missing file is only not found so far.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    exact = files.select(F.col("path").alias("target"), F.lit(True).alias("exact"))
    named = files.groupBy(base(F.col("path")).alias("base")).agg(F.min("path").alias("candidate"))
    met = links.withColumn("base", base(F.col("target"))).join(exact, "target", "left").join(named, "base", "left")
    missing = F.when(F.lit(True) if complete is None else complete, "notFound").otherwise("searchIncomplete")
    state = F.when(F.col("exact"), "resolved").when(F.col("candidate").isNotNull(), "renamedCandidate").otherwise(missing)
    return met.select("link_id", state.alias("state"), F.when(F.col("exact"), F.col("target")).otherwise(F.col("candidate")).alias("path"))


def resolve_passages(anchors: DataFrame, items: DataFrame) -> DataFrame:
    """anchors (anchor_id, item_id, block) with a status: resolved, sourceDeleted, wrongKind or malformed."""
    met = anchors.join(items.select("item_id", F.col("kind").alias("item_kind")), "item_id", "left")
    status = F.when(F.col("item_id").isNull() | F.col("block").isNull(), "malformed").when(F.col("item_kind").isNull(), "sourceDeleted").when(F.col("item_kind") != "note", "wrongKind").otherwise("resolved")
    return met.select("anchor_id", status.alias("status"))


def missing_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs (job_id, readable) with the status of their result, or an explicit error where there is none."""
    met = jobs.join(results.select("job_id", F.col("status").alias("got")), "job_id", "left")
    return met.select("job_id", F.coalesce("got", F.when(F.col("readable"), "no_result").otherwise("image_unreadable")).alias("status"))


def apply_batch(current: DataFrame, changed: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """current after an upsert of changed rows and then the removal of deleted keys."""
    return upsert(current, changed, key).join(deleted.select(key), key, "left_anti")


def replace_organization(folders: DataFrame, memberships: DataFrame, assignments: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables that take the place of the old ones, in the order in which they may be written.

    Folders whose parent is not among them become roots; memberships need their folder and their item, and are there once;
    assignments need their folder, and of several of one folder the least template counts.
    """
    ids = folders.select("folder_id").distinct()
    known = ids.select(F.col("folder_id").alias("parent_id"), F.lit(True).alias("known"))
    kept = folders.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id"))).select(folders.columns)
    inside = memberships.select("item_id", "folder_id").distinct().join(ids, "folder_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi")
    assigned = assignments.join(ids, "folder_id", "left_semi").groupBy("folder_id").agg(F.min("template_id").alias("template_id"))
    return kept, inside.select("item_id", "folder_id"), assigned
