"""Partial dates: strings with a precision, sort keys, and a calendar that is Julian before 1582."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.facets import MONTHS


def is_leap(year: Column) -> Column:
    gregorian = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(year < 1582, year % 4 == 0).otherwise(gregorian)


def days_in_month(year: Column, month: Column) -> Column:
    """Days of a month; null outside 1 to 12. October 1582 counts 31, as any day number in it may be written."""
    return F.when(month == 2, F.when(is_leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31)


def is_valid_day(year: Column, month: Column, day: Column) -> Column:
    return F.coalesce((day >= 1) & (day <= days_in_month(year, month)), F.lit(False))


def _parts(date: Column) -> list[Column]:
    pieces = F.array_remove(F.split(F.trim(date), "-"), "")
    return [F.get(pieces, i).try_cast("int") for i in range(3)]


def item_sort_date(date: Column, precision: Column) -> Column:
    """Sort key of a date at its precision; null where the text is coarser than that."""
    year, month, day = _parts(date)
    alone = F.trim(date).try_cast("int")
    return (
        F.when(precision == "decade", alone * 10000)
        .when(precision == "month", year * 10000 + month * 100)
        .when(precision == "day", year * 10000 + month * 100 + day)
        .otherwise(alone * 10000)
    )


def normalized_date(date: Column, precision: Column) -> Column:
    """struct(date, precision): impossible parts are left off, decades floored, months and days padded; null without a year."""
    year, month, day = _parts(date)
    month = F.when(month.between(1, 12), month)
    day = F.when(is_valid_day(year, month, day), day)
    wants = F.coalesce(precision, F.lit("year"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    level = F.when(wants == "decade", "decade").when(wants.isin("month", "day") & month.isNotNull(), F.when((wants == "day") & day.isNotNull(), "day").otherwise("month")).otherwise("year")
    text = (
        F.when(level == "decade", (F.floor(year / 10) * 10).cast("string"))
        .when(level == "day", F.concat_ws("-", year.cast("string"), two(month), two(day)))
        .when(level == "month", F.concat_ws("-", year.cast("string"), two(month)))
        .otherwise(year.cast("string"))
    )
    return F.when(year > 0, F.struct(text.alias("date"), level.alias("precision")))


def month_number(text: Column) -> Column:
    """1 to 12 from `03 March`, a bare number or a name anywhere in the text."""
    t = F.trim(text)
    number = F.left(t, F.lit(2)).try_cast("int")
    named = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(MONTHS))):
        named = F.when(F.contains(F.lower(t), F.lit(name.lower())), i + 1).otherwise(named)
    return F.when(number.between(1, 12), number).otherwise(named)


def month_tag(month: Column) -> Column:
    return F.when(month.between(1, 12), F.format_string("%02d %s", month, F.element_at(F.lit(MONTHS), F.when(month.between(1, 12), month).otherwise(1))))


def day_number(text: Column) -> Column:
    number = F.regexp_replace(text, "[^0-9]", "").try_cast("int")
    return F.when(number.between(1, 31), number)


def machine_date(year: Column, month: Column, day: Column) -> Column:
    """Year, then the month it can read, then the day it can read."""
    m, d = month_number(month), day_number(day)
    two = lambda n: F.format_string("-%02d", n)
    return F.concat(year, F.coalesce(F.when(m.isNotNull(), F.concat(two(m), F.coalesce(F.when(d.isNotNull(), two(d)), F.lit("")))), F.lit("")))
