"""Analytics over ordered pages: segments, runs, forward fill, context and numbering.

Pages have a group (a session, a shelf), a seq within it, and a classification: Document Start, Continuation, Box,
Folder, or null for unknown. Groups of any size are folded in chunks (quire.operators.chunks), so none meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import chunks
from quire.operators.chunks import Ordered
from quire.operators.ranking import with_place_in
from quire.session import cut

START, CONTINUATION, MARKERS = "Document Start", "Continuation", ("Box", "Folder")


def is_marker(kind: Column) -> Column:
    return F.coalesce(kind.isin(*MARKERS), F.lit(False))


def segments(pages: DataFrame, group: str, seq: str = "seq", kind: str = "classification") -> DataFrame:
    """segment, from 0 in each group: markers stand alone, starts and unknown pages open one, continuations join it."""
    k = F.col(kind)
    before = F.col("before_")
    opens = is_marker(k) | k.isNull() | (k == START) | before.isNull() | is_marker(before["v"])
    found = Ordered(pages, group, seq).with_folds(before_=chunks.lag(k)).map(opens_=opens.cast("int")).with_folds(segment=chunks.running_sum(F.col("opens_")))
    return found.rows().withColumn("segment", F.col("segment") - 1).drop("before_", "opens_")


def segment_rows(pages: DataFrame, group: str, text: str = "text") -> DataFrame:
    """One row per segment: its pages, whether it is a marker, and its texts joined by a blank line."""
    grouped = segments(pages, group).groupBy(group, "segment").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.max(is_marker(F.col("classification"))).alias("is_marker"),
        F.min("seq").alias("first_seq"),
        F.array_sort(F.collect_list(F.struct("seq", F.coalesce(text, F.lit("")).alias("t")))).alias("parts"),
    )
    return grouped.select(group, "segment", "n_pages", "is_marker", "first_seq", F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("text"))


def runs(pages: DataFrame, group: str, seq: str = "seq", kind: str = "classification") -> DataFrame:
    """run, from 0: a page and the continuations after it. Unlike a segment, a run may go on from a marker."""
    goes_on = F.coalesce(F.col(kind) == CONTINUATION, F.lit(False))
    found = Ordered(pages, group, seq).with_folds(run=chunks.running_sum((~goes_on).cast("int")), begins_=chunks.first_known(goes_on.cast("int")))
    return found.rows().withColumn("run", F.col("run") - 1 + F.col("begins_")).drop("begins_")  # a group that begins with a continuation has no row that opens its first run


def selected_runs(pages: DataFrame, group: str, selected: Column) -> DataFrame:
    """All pages of the runs that hold a selected page."""
    known = runs(pages, group)
    return known.join(known.where(selected).select(group, "run").distinct(), [group, "run"], "left_semi")


def collections(pages: DataFrame, group: str, box: Column, default: str = "Uncategorized") -> DataFrame:
    """collection: the latest box name; before the first box that one's; without any box the default. place: by first page."""
    found = Ordered(pages, group, "seq").map(box_=box).with_folds(last_=chunks.last(F.col("box_")), first_=chunks.first_known(F.col("box_")))
    filled = found.map(collection=F.coalesce("last_", "first_", F.lit(default))).rows().drop("last_", "first_", "box_")
    first = filled.groupBy(F.col(group).alias("of_"), F.col("collection").alias("named_")).agg(F.min("seq").alias("first_seq"))
    places = cut(first.withColumn("place", F.dense_rank().over(Window.partitionBy("of_").orderBy("first_seq"))).drop("first_seq"))  # a row for each collection
    side = F.broadcast(places) if places.count() <= chunks.MOST_BROADCAST else places
    return filled.join(side, F.col(group).eqNullSafe(F.col("of_")) & (F.col("collection") == F.col("named_"))).drop("of_", "named_")


def as_of_box(pages: DataFrame, group: str, box: Column, current: Column) -> DataFrame:
    """assigned: the greatest box at or before a page; before the first box, and for boxes, the current key stays."""
    found = Ordered(pages, group, "seq").map(box_=box, current_=current).with_folds(last_=chunks.last(F.col("box_")))
    assigned = F.when(F.col("box_").isNotNull(), F.col("current_")).otherwise(F.coalesce("last_", "current_"))
    return found.map(assigned=assigned).rows().drop("box_", "current_", "last_")


def nearby(segment_table: DataFrame, group: str, text: str = "text", n: int = 3, most: int = 300) -> DataFrame:
    """context: of n segments before and n after, the first n of that list, each cut, joined by a rule."""
    return chunks.with_neighbours(segment_table, group, "segment", n, "context", F.left(text, F.lit(most)), lambda before, after: F.array_join(F.slice(F.concat(before, after), 1, n), "\n---\n"))


def previous_tail(pages: DataFrame, group: str, text: str = "text", n: int = 200) -> DataFrame:
    found = Ordered(pages, group, "seq").map(cut_=F.right(text, F.lit(n))).with_folds(before_=chunks.lag(F.col("cut_")))
    return found.map(tail=F.col("before_.v")).rows().drop("cut_", "before_")


def triage(rows: DataFrame, order: str, wanted: Column, partition: str | None = None) -> DataFrame:
    """next_wanted and previous_wanted: the nearest row after and before that is wanted, going round at the ends.

    Without a partition all rows are one group, which is no more one task's than any other hot group.
    """
    named = (rows if partition else rows.withColumn("all_", F.lit(0))).withColumn("hit_", F.when(wanted, F.col(order)))
    hit = F.col("hit_")
    found = Ordered(named, partition or "all_", order).with_folds(after_=chunks.following(hit), before_=chunks.last(hit, before=True), least_=chunks.least(hit), most_=chunks.greatest(hit))
    return found.map(next_wanted=F.coalesce("after_", "least_"), previous_wanted=F.coalesce("before_", "most_")).rows().drop("all_", "hit_", "after_", "before_", "least_", "most_")


def find_positions(panes: DataFrame, document: str, pane: str, n: str) -> DataFrame:
    """One row per match: its pane, ordinal in the pane, 1-based position in the document, and the neighbours going round.

    What is summed up is a row for each pane, whose matches then follow from its sum.
    """
    held = panes.where(F.col(n) > 0).select(document, pane, F.col(n).cast("int").alias("n_"))
    summed = Ordered(held, document, pane).with_folds(to_=chunks.running_sum(F.col("n_")), total=chunks.total(F.col("n_"))).rows()
    each = summed.select(document, pane, "total", (F.col("to_") - F.col("n_")).alias("before_"), F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("ordinal"))
    placed = each.withColumn("position", F.col("before_") + F.col("ordinal") + 1).drop("before_")
    following = F.col("position") % F.col("total") + 1
    preceding = (F.col("position") + F.col("total") - 2) % F.col("total") + 1
    return placed.withColumns({"following": following, "preceding": preceding})


def page_pairs(page: Column, n_pages: Column) -> dict[str, Column]:
    """Pages two by two: how many pairs, which one a page is in, and whether it is the image side."""
    return {"n_pairs": F.floor((n_pages + 1) / 2).cast("long"), "pair": F.floor(page / 2).cast("long"), "is_image": page % 2 == 0}


def occurrences(text: Column, wanted: str) -> Column:
    """How often a literal stands in a text, whatever the case."""
    n = len(wanted)
    if not n:
        return F.lit(0).cast("long")
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(wanted.lower()), F.lit("")))) / n).cast("long")


def highest_number(names: DataFrame, name: str = "name") -> DataFrame:
    """The greatest five-digit prefix of the names, 0 without one."""
    return names.agg(F.coalesce(F.max(F.regexp_extract(name, "^([0-9]{5}) ", 1).try_cast("int")), F.lit(0)).cast("long").alias("highest"))


def numbered(rows: DataFrame, group: str, order: str, base: int = 0) -> DataFrame:
    """file_name: five digits after the base, then the group. No group of many rows meets in one task."""
    placed = with_place_in(rows, group, [order], "place_in_group")
    return placed.withColumn("file_name", F.format_string("%05d %s", (F.lit(base) + F.col("place_in_group")).cast("int"), F.col(group))).drop("place_in_group")


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """unique_name: later rows of a name, whatever the case, get 2, 3 and so on; numbers that a literal name has are skipped."""
    key = F.lower(name)
    literal = rows.select(F.regexp_extract(key, "^(.*) ([0-9]+)$", 1).alias("stem"), F.regexp_extract(key, "^(.*) ([0-9]+)$", 2).try_cast("int").alias("number")).where("number >= 2")
    taken = literal.groupBy("stem").agg(F.array_sort(F.collect_set("number")).alias("taken"))
    met = with_place_in(rows.withColumn("key", key), "key", [order], "nth").join(taken, F.col("key") == F.col("stem"), "left")
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("nth").cast("int"), lambda n, t: F.when((n >= 2) & (t <= n), n + 1).otherwise(n))
    return met.withColumn("unique_name", F.when(F.col("nth") == 1, F.col(name)).otherwise(F.concat_ws(" ", name, number))).drop("nth", "key", "stem", "taken")


def capture_groups(photos: DataFrame) -> DataFrame:
    """Photos by group: order of its first, that one's type and priority, and the first year and month that are known."""
    by_seq = lambda c: F.min_by(c, "seq")
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return photos.groupBy("group_id").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_photos"), by_seq("type").alias("type"), by_seq("priority").alias("priority"), known("year").alias("year"), known("month").alias("month"))


def majority(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """The most frequent vote; of ties the smallest."""
    counted = votes.groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.max_by(vote, F.struct("n", (-F.col(vote)).alias("minus"))).alias("vote"), F.max("n").alias("n_votes"))
