"""Change feeds reduced to what has to be read again, and applied to a table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.filters import is_temporary_sibling

#: Kinds of change, the strongest first.
PRECEDENCE = {"root_changed": 4, "full_rescan": 3, "subtree": 2, "path": 1}


def _ancestors(path: Column, own: bool) -> Column:
    """The folders above a path, and the path itself if asked for."""
    parts = F.split(path, "/")
    last = F.size(parts) - (0 if own else 1)
    return F.when(last >= 2, F.transform(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def reduce_changes(events: DataFrame) -> DataFrame:
    """root, kind and path to read again, of events (root, kind, path, own).

    Own events and scratch files of atomic saves do not count. A root that changed, or that needs a full scan, needs
    nothing else; otherwise subtrees within others, and paths under a subtree, are absorbed. Reducing the union of two
    reduced feeds gives the same as reducing both at once.
    """
    heard = events.where(~F.col("own") & ~F.coalesce(is_temporary_sibling(F.col("path")), F.lit(False)))
    level = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in PRECEDENCE.items()))
    top = heard.groupBy("root").agg(F.max(level).alias("top"))
    whole = top.where("top >= 3").select("root", F.when(F.col("top") == 4, "root_changed").otherwise("full_rescan").alias("kind"), F.lit(None).cast("string").alias("path"))
    rest = heard.join(top.where("top < 3"), "root", "left_semi").select("root", "kind", "path").distinct()
    trees = rest.where("kind = 'subtree'").select("root", F.col("path").alias("above"))
    inside = rest.withColumn("above", F.explode(_ancestors(F.col("path"), False))).join(trees, ["root", "above"], "left_semi").select("root", "kind", "path").distinct()
    same = rest.where("kind = 'path'").join(trees.withColumnRenamed("above", "path"), ["root", "path"], "left_semi").select("root", "kind", "path")
    kept = rest.join(inside.unionByName(same).distinct(), ["root", "kind", "path"], "left_anti")
    return whole.unionByName(kept)


def apply_changes(table: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """table (path, value) after re-reading: fresh (path, value, status) of changed (path, clean) paths and subtrees.

    status is read, unreadable or vanished: an unreadable file keeps its last known row, a vanished one goes. Rows of a
    subtree that were not seen again go only if its scan was clean.
    """
    under = table.select("path", F.explode(_ancestors(F.col("path"), True)).alias("at")).join(changed.where("clean").select(F.col("path").alias("at")), "at", "left_semi").select("path").distinct()
    seen = fresh.select("path", F.col("value").alias("new_value"), "status")
    met = table.join(seen, "path", "full_outer").join(under.withColumn("scanned", F.lit(True)), "path", "left")
    goes = (F.col("status") == "vanished") | (F.col("status").isNull() & F.col("scanned"))
    kept = met.where(~F.coalesce(goes, F.lit(False)) & ~F.coalesce((F.col("status") == "unreadable") & F.col("value").isNull(), F.lit(False)))
    return kept.select("path", F.when(F.col("status") == "read", F.col("new_value")).otherwise(F.col("value")).alias("value"))
