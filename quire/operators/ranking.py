"""Places in a total order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

#: monotonically_increasing_id() keeps the partition above these bits and the row's number in it below.
ROW_BITS = 33


def with_place(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their 1-based place in the order, whose last keys should leave no ties.

    The sort deals rows to ranges; each range numbers its own, and the counts of the ranges, a row for each shuffle
    partition, give the offsets. The numbered rows are written to the shared folder once, so that a lost task sorts again
    without moving any number.
    """
    sorted_rows = cut(rows.orderBy(*order).withColumn("rank_n_", F.monotonically_increasing_id()))
    part = F.shiftright("rank_n_", ROW_BITS).alias("rank_part_")
    counts = sorted_rows.groupBy(part).agg(F.count(F.lit(1)).alias("rank_held_"))
    before = Window.orderBy("rank_part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("rank_part_", F.coalesce(F.sum("rank_held_").over(before), F.lit(0)).alias("rank_first_"))
    numbered = sorted_rows.withColumn("rank_part_", part).join(F.broadcast(offsets), "rank_part_")
    return numbered.withColumn(name, F.col("rank_first_") + F.col("rank_n_").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1).drop("rank_n_", "rank_part_", "rank_first_")


#: A group with so many rows that also has this share of all rows is hot; so there are at most as many as the inverse of the share.
HOT_ROWS = 10_000
HOT_SHARE = 1 / (1 << 17)


def with_place_in(rows: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """rows with their 1-based place in the order within their group; null is a group, and the order should leave no ties.

    Rows of hot groups, which are found by their counts, are numbered by ranges of the whole order, less where their group
    starts; so no hot group meets in one task. Other groups have a window each. The tables of hot groups have 131,072 rows
    at most and are broadcast.
    """
    counts = cut(rows.groupBy(F.col(group).alias("hot_")).agg(F.count(F.lit(1)).alias("rank_held_")))
    seen = counts.agg(F.sum("rank_held_").alias("total"), F.max("rank_held_").alias("most")).first()
    bound = max(HOT_ROWS, (seen["total"] or 0) * HOT_SHARE)
    own = Window.partitionBy(group).orderBy(*order)
    if (seen["most"] or 0) < bound:
        return rows.withColumn(name, F.row_number().over(own).cast("long"))
    hot = F.broadcast(counts.where(F.col("rank_held_") >= bound).select("hot_"))
    is_hot = F.col(group).eqNullSafe(F.col("hot_"))
    others = rows.join(hot, is_hot, "left_anti").withColumn(name, F.row_number().over(own).cast("long"))
    placed = with_place(rows.join(hot, is_hot, "left_semi"), [group, *order], "at_").select(*rows.columns, "at_")
    starts = placed.groupBy(F.col(group).alias("hot_")).agg(F.min("at_").alias("start_"))
    numbered = placed.join(F.broadcast(starts), is_hot).withColumn(name, F.col("at_") - F.col("start_") + 1)
    return others.unionByName(numbered.select(*others.columns))
