"""Column expressions that several operators share; all of them are built-in functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: Column) -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t to \\r."""
    return F.array_remove(F.split(whole(text), SPACE), "")


def shingle_hashes(ws: Column, n: int) -> Column:
    """One 64-bit hash for each run of n words, repeats included; of fewer words the whole sequence, of none nothing.

    xxhash64 of several columns seeds each hash with the one before, so no joined string is built.
    """
    runs = F.transform(
        F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, n))),
    )
    short = F.when(F.size(ws) > 0, F.array(F.xxhash64(F.concat_ws(" ", ws)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(ws) >= n, runs).otherwise(short)


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of the parts; every SQL engine gives the same one."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what a worker makes of each stays small. Spark bounds a batch by its bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ordered_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rows of a key in one partition, one after the other and in order (nulls first), for operators that pass over them as a stream."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """For the queries and the pipeline, which own their session: fewer rows at a time between Spark and Python, for less memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
