"""Sort keys: natural order of names, and missing values last in both directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 12


def natural_key(text: Column) -> Column:
    """Case-insensitive, with runs of digits padded so that they compare as numbers; accents and punctuation as they are."""
    parts = F.regexp_extract_all(text, F.lit("(\\d+|\\D+)"), F.lit(1))
    return F.lower(F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, DIGITS, "0")).otherwise(p)), ""))


def missing_last(column: Column, descending: bool = False) -> Column:
    return column.desc_nulls_last() if descending else column.asc_nulls_last()
