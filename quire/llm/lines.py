"""Line dedup by overlapping windows of three lines.

Each run of three consecutive lines of a text is hashed. Of a window that the corpus has twice or more, the occurrence
with the smallest (doc_id, text hash, line) is the first; all others are later ones, and a text loses every line that
a later occurrence covers, overlaps merged. Texts of fewer than three lines have no window and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.joins import by_counted_key
from quire.llm.text import WORD, let, whole
from quire.session import cut

WINDOW = 3

def window_hashes(text: Column, n: int = WINDOW) -> Column:
    """One hash per run of n lines, in order."""
    return let(
        F.split(whole(text), "\n"),
        lambda ls: F.transform(
            F.slice(ls, F.lit(1), F.greatest(F.size(ls) - (n - 1), F.lit(0))),
            lambda line, i: F.xxhash64(line, *(F.get(ls, i + k) for k in range(1, n))),
        ),
    )


def later_occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """doc_id, version (hash of the text) and starts: the first lines of later occurrences. Rows with none are left out.

    Rows that share both doc_id and text are one document. Windows are counted with map-side sums; a hot one is found
    by its count and joined by broadcast, the others by shuffle, so no key's occurrences meet in one task.
    """
    at = docs.select(F.col(key).alias("doc_id"), F.xxhash64(whole(F.col(text))).alias("version"), F.posexplode(window_hashes(F.col(text), n)).alias("start", "h"))
    place = F.struct("doc_id", "version", "start")
    repeated = cut(at.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1"))
    later = by_counted_key(at, repeated, "h", "times").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "version").agg(F.collect_set("start").alias("starts"))


def without(text: Column, starts: Column, n: int = WINDOW) -> Column:
    """The text without the lines that windows at these starts cover."""
    covered = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (n - 1))))
    return let(
        F.split(whole(text), "\n"),
        lambda ls: F.array_join(
            F.transform(F.array_except(F.transform(ls, lambda _, i: i), covered), lambda i: F.get(ls, i)),
            "\n",
        ),
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Each row of docs as `row`, with n_lines, n_removed and text: the text that stays ('' for a null one).

    Identical rows are kept alike; null ids are a key of their own; texts of any length are taken whole; an empty table
    gives no rows; columns of any name go along inside `row`.
    """
    marks = later_occurrences(docs, key, text, n)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(whole(F.col(text))).alias("v"))
    met = rows.join(marks, F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("v") == F.col("version")), "left")
    body = F.col("row")[text]
    n_lines = F.size(F.split(whole(body), "\n"))
    stays = F.when(F.col("starts").isNull(), whole(body)).otherwise(without(body, F.col("starts"), n))
    removed = F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (n - 1)))))), F.lit(0))
    return met.select("row", n_lines.cast("long").alias("n_lines"), F.when(F.col("starts").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"), stays.alias("text"))


def keep_rest(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with the remaining texts and their lengths; a document that lost lines and has no word left is dropped."""
    out = dedup(docs, key, text)
    left = out.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    changed = {text: F.when(F.col("n_removed") == 0, F.col("row")[text]).otherwise(F.col("text")), n_chars: F.when(F.col("n_removed") == 0, F.col("row")[n_chars]).otherwise(F.length("text").cast("long"))}
    return left.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
