"""Notes as rows: what a list shows of them, and filling their fields from fetched records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.facets import MONTHS

STARS = 5


def display_date(date: Column, precision: Column) -> Column:
    """A date as it is read: decade with an s, month and day by name; the text as it is where a part is missing."""
    parts = F.array_remove(F.split(date, "-"), "")
    month, day = F.get(parts, F.lit(1)).try_cast("int"), F.get(parts, F.lit(2)).try_cast("int")
    name = F.when(month.between(1, 12), F.element_at(F.lit([m[:3] for m in MONTHS]), F.when(month.between(1, 12), month).otherwise(1)))
    text = (
        F.when(precision == "decade", F.concat(date, F.lit("s")))
        .when((precision == "month") & name.isNotNull(), F.concat_ws(" ", name, F.get(parts, F.lit(0))))
        .when((precision == "day") & name.isNotNull() & day.isNotNull(), F.concat(name, F.lit(" "), day, F.lit(", "), F.get(parts, F.lit(0))))
        .otherwise(date)
    )
    return F.when(date != "", text)


def quality_stars(quality: Column) -> Column:
    """Filled and empty stars, five in all; a dash without a rating."""
    filled = F.least(quality, F.lit(STARS)).cast("int")
    return F.when(quality >= 1, F.concat(F.repeat(F.lit("★"), filled), F.repeat(F.lit("☆"), STARS - filled))).otherwise("—")


def display_tags(tags: Column, hidden: Column | str) -> Column:
    """Tags joined, without the marker of managed ones, whatever its case."""
    marker = F.lit(hidden) if isinstance(hidden, str) else hidden
    return F.array_join(F.filter(tags, lambda t: F.lower(t) != F.lower(marker)), ", ")


def sources_text(n: Column) -> Column:
    return F.when(n > 0, n.cast("string")).otherwise("")


def summaries(items: DataFrame, hidden: str) -> DataFrame:
    """The list's columns of each item (item_id, title, authors, date, precision, quality, tags, n_sources); arrays may be JSON text."""
    kinds = dict(items.dtypes)
    listed = lambda c: F.from_json(c, "array<string>") if kinds[c] == "string" else F.col(c)
    return items.select(
        "item_id",
        "title",
        F.array_join(listed("authors"), "; ").alias("authors"),
        display_date(F.col("date"), F.col("precision")).alias("date"),
        quality_stars(F.col("quality")).alias("stars"),
        display_tags(listed("tags"), hidden).alias("tags"),
        sources_text(F.col("n_sources")).alias("sources"),
    )


def fill_plan(current: dict[str, Column], fetched: dict[str, Column]) -> Column:
    """structs (field, replaces) of the fields that a fetched record would change; empty fetched values change nothing."""
    empty = lambda c: c.isNull() | (c == "")
    each = [F.when(~empty(fetched[f]) & ~fetched[f].eqNullSafe(current[f]), F.struct(F.lit(f).alias("field"), (~empty(current[f])).alias("replaces"))) for f in fetched]
    return F.array_compact(F.array(*each))


def filled(current: dict[str, Column], fetched: dict[str, Column], plan: Column, selected: Column) -> dict[str, Column]:
    """The fields after the selected changes of a plan; all others stay."""
    chosen = lambda f: F.exists(plan, lambda p: p["field"] == f) & F.array_contains(selected, F.lit(f))
    return {f: F.when(chosen(f), fetched[f]).otherwise(current[f]) if f in fetched else current[f] for f in current}
