"""Windows over ordered groups of any size: rows in chunks, each folded to a carry, carries scanned, and then applied.

A window of Spark sorts a whole group in one task. Where a group is hot, its rows are numbered by ranges of the whole order
(with_place_in), and CHUNK consecutive ones are a chunk. A running figure is then that within the chunk, joined with what
comes in from the chunks before: a row of carries for each chunk, which is scanned by a window over the chunks. Groups that
are not hot keep the plain window, of which the same folds are made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import ranking
from quire.session import cut

#: Rows of a chunk.
CHUNK = 8192
#: So many rows of carries meet the rows by broadcast.
MOST_BROADCAST = 100_000
FIRST, LAST, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


@dataclass(frozen=True)
class Fold:
    """A figure of each row of an ordered group.

    local: the figure within a window (given by group or chunk, in order); carry: an aggregate of a chunk, in which place
    orders rows; scanned: carries to what comes in, over chunks in order; joined: both to the figure.
    """

    local: Callable[[object], Column]
    carry: Callable[[Column], Column]
    scanned: Callable[[object, Column], Column]
    joined: Callable[[Column, Column], Column]


def _at_known(value: Column, place: Column) -> Column:
    return F.when(value.isNotNull(), place)


def last(value: Column, before: bool = False) -> Fold:
    """The last value that is not null, up to the row, or before it."""
    end = -1 if before else HERE
    return Fold(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(FIRST, end)),
        lambda place: F.max_by(value, _at_known(value, place)),
        lambda w, c: F.last(c, ignorenulls=True).over(w.rowsBetween(FIRST, -1)),
        F.coalesce,
    )


def following(value: Column) -> Fold:
    """The first value after the row that is not null."""
    return Fold(
        lambda w: F.first(value, ignorenulls=True).over(w.rowsBetween(1, LAST)),
        lambda place: F.min_by(value, _at_known(value, place)),
        lambda w, c: F.first(c, ignorenulls=True).over(w.rowsBetween(1, LAST)),
        F.coalesce,
    )


def lag(value: Column) -> Fold:
    """The value of the row before, in a struct, which is null for the first row only."""
    held = F.struct(value.alias("v"))
    return Fold(lambda w: F.lag(held).over(w), lambda place: F.max_by(held, place), lambda w, c: F.lag(c).over(w), F.coalesce)


def running_sum(value: Column) -> Fold:
    """The sum up to the row, 0 where all is null."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return Fold(lambda w: zero(F.sum(value).over(w.rowsBetween(FIRST, HERE))), lambda place: zero(F.sum(value)), lambda w, c: F.sum(c).over(w.rowsBetween(FIRST, -1)), lambda a, b: a + zero(b))


def _whole(aggregate: Callable[[Column], Column], value: Column) -> Fold:
    return Fold(lambda w: aggregate(value).over(w.rowsBetween(FIRST, LAST)), lambda place: aggregate(value), lambda w, c: aggregate(c).over(w.rowsBetween(FIRST, LAST)), lambda a, b: F.coalesce(b, a))


def least(value: Column) -> Fold:
    """The least value of the group."""
    return _whole(F.min, value)


def greatest(value: Column) -> Fold:
    return _whole(F.max, value)


def total(value: Column) -> Fold:
    return _whole(F.sum, value)


def first_known(value: Column) -> Fold:
    """The group's first value that is not null."""
    return Fold(
        lambda w: F.first(value, ignorenulls=True).over(w.rowsBetween(FIRST, LAST)),
        lambda place: F.min_by(value, _at_known(value, place)),
        lambda w, c: F.first(c, ignorenulls=True).over(w.rowsBetween(FIRST, LAST)),
        lambda a, b: F.coalesce(b, a),
    )


class Ordered:
    """Rows of groups in an order without ties. with_folds() may be called in turn; rows of hot groups are numbered once."""

    def __init__(self, rows: DataFrame, group: str, order: str):
        self.group, self.order, self.columns = group, order, rows.columns
        counts = rows.groupBy(F.col(group).alias("hot_")).agg(F.count(F.lit(1)).alias("held_"))
        seen = counts.agg(F.sum("held_").alias("total"), F.max("held_").alias("most")).first()
        bound = max(ranking.HOT_ROWS, (seen["total"] or 0) * ranking.HOT_SHARE)
        self.few, self.chunked = rows, None
        if (seen["most"] or 0) >= bound:
            hot = F.broadcast(cut(counts.where(F.col("held_") >= bound).select("hot_")))
            is_hot = F.col(group).eqNullSafe(F.col("hot_"))
            self.few = rows.join(hot, is_hot, "left_anti")
            placed = ranking.with_place(rows.join(hot, is_hot, "left_semi"), [group, order], "place_")
            self.chunked = placed.withColumn("chunk_", F.floor(F.col("place_") / CHUNK).cast("long"))

    def with_folds(self, **folds: Fold) -> Ordered:
        """The rows with these figures as columns."""
        plain = Window.partitionBy(self.group).orderBy(self.order)
        names = [c for c in self.columns if c not in folds]
        self.few = self.few.select(*names, *(f.joined(f.local(plain), F.lit(None)).alias(n) for n, f in folds.items()))
        if self.chunked is not None:
            place = F.col("place_")
            carries = self.chunked.groupBy(F.col(self.group).alias("of_"), "chunk_").agg(*(f.carry(place).alias(f"carry_{n}") for n, f in folds.items()))
            by_chunk = Window.partitionBy("of_").orderBy("chunk_")
            incoming = cut(carries.select("of_", F.col("chunk_").alias("in_"), *(f.scanned(by_chunk, F.col(f"carry_{n}")).alias(f"in_{n}") for n, f in folds.items())))
            within = Window.partitionBy(self.group, "chunk_").orderBy("place_")
            local = self.chunked.select(*names, "place_", "chunk_", *(f.local(within).alias(f"local_{n}") for n, f in folds.items()))
            side = F.broadcast(incoming) if incoming.count() <= MOST_BROADCAST else incoming
            met = local.join(side, F.col(self.group).eqNullSafe(F.col("of_")) & (F.col("chunk_") == F.col("in_")))
            self.chunked = met.select(*names, "place_", "chunk_", *(f.joined(F.col(f"local_{n}"), F.col(f"in_{n}")).alias(n) for n, f in folds.items()))
        self.columns = [*names, *folds]
        return self

    def map(self, **columns: Column) -> Ordered:
        """The rows with columns made of each row by itself."""
        self.few = self.few.withColumns(columns)
        self.chunked = self.chunked.withColumns(columns) if self.chunked is not None else None
        self.columns = [*(c for c in self.columns if c not in columns), *columns]
        return self

    def rows(self) -> DataFrame:
        few = self.few.select(*self.columns)
        return few if self.chunked is None else few.unionByName(self.chunked.select(*self.columns))


def with_neighbours(rows: DataFrame, group: str, number: str, n: int, name: str, value: Column, made: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with a column made of arrays of a value from the n rows before and the n after.

    number counts the rows of a group without gaps; so chunks are known, and the n rows at each end are also sent to the neighbouring one.
    """
    chunk, at = F.floor(F.col(number) / CHUNK).cast("long"), F.pmod(F.col(number), F.lit(CHUNK))
    seats = F.array_compact(F.array(chunk, F.when(at < n, chunk - 1), F.when(at >= CHUNK - n, chunk + 1)))
    sent = rows.withColumn("value_", value).withColumn("own_", chunk).withColumn("seat_", F.explode(seats))
    spec = Window.partitionBy(group, "seat_").orderBy(number)
    both = sent.withColumn(name, made(F.collect_list("value_").over(spec.rowsBetween(-n, -1)), F.collect_list("value_").over(spec.rowsBetween(1, n))))
    return both.where(F.col("seat_") == F.col("own_")).drop("value_", "own_", "seat_")
