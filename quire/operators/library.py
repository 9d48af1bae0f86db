"""Facet counts, reports, roll-ups and sorting over a library of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ordering import missing_last, natural_key
from quire.operators.ranking import with_place

BIG = "long"


def count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast(BIG)


def file_type(path: Column) -> Column:
    extension = F.regexp_extract(path, "\\.([^./]+)$", 1)
    return F.when(extension == "", "File").otherwise(F.upper(extension))


def rows(files: DataFrame) -> DataFrame:
    """The displayed row: name, type and facets."""
    return files.select("doc_id", "name", file_type(F.col("path")).alias("file_type"), "read_state", "quality", "priority", "sort_date", "display_date")


def subject_counts(files: DataFrame) -> DataFrame:
    """Files per subject, each file once."""
    return files.select(F.explode(F.array_distinct("subjects")).alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n_files"))


def date_like(token: Column) -> Column:
    return token.rlike("^[0-9]{3,4}s?$") | token.rlike("(?i)^day [0-9]+$") | token.rlike("(?i)^[0-9]{1,2} (january|february|march|april|may|june|july|august|september|october|november|december)$")


def tag_cloud(shown: DataFrame) -> DataFrame:
    """Subject counts of the shown rows without date-like tokens, with their place in natural order."""
    counted = subject_counts(shown).where(~date_like(F.col("subject")))
    return with_place(counted, [natural_key(F.col("subject")), "subject"])


def data_quality(files: DataFrame) -> DataFrame:
    """One row of counts; a document with a decade only has no date."""
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("year").isNull()).alias("no_date"),
        count_if(F.col("priority").isNull()).alias("no_priority"),
        count_if(F.col("date_uncertain")).alias("date_uncertain"),
        count_if(F.exists("tags", lambda t: F.lower(t) == "read") & F.exists("tags", lambda t: F.lower(t) == "unread")).alias("both_read_unread"),
        count_if(F.col("color").isNotNull()).alias("markers"),
    )


def attention(files: DataFrame) -> DataFrame:
    return files.agg(count_if(~F.col("readable") | ~F.col("has_text")).alias("needs_attention"), F.count(F.lit(1)).alias("indexed"))


def duplicated_names(files: DataFrame) -> DataFrame:
    """Names that two files or more have, whatever the case, with the parent folder that tells them apart."""
    counts = files.groupBy(F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("n_same")).where("n_same >= 2")
    parent = F.element_at(F.split("folder", "/"), -1)
    return files.withColumn("key", F.lower("name")).join(counts, "key").select("doc_id", "name", parent.alias("parent"), "n_same")


def folder_counts(files: DataFrame) -> DataFrame:
    """Files at or under each folder of their paths."""
    parts = F.split("folder", "/")
    least = F.when(F.startswith("folder", F.lit("/")), 2).otherwise(1)  # the root of an absolute path is no folder
    prefixes = F.transform(F.sequence(least, F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.where("folder <> '/'").select(F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))


def saved_filter_counts(files: DataFrame, filters: dict) -> DataFrame:
    """One pass for all saved filters; their text queries and attention flags play no part."""
    from dataclasses import replace

    return files.agg(*(count_if(replace(f, needs_attention=False).column()).alias(name) for name, f in filters.items()))


def group_summary(files: DataFrame, group: str) -> DataFrame:
    """Subjects that all, and that only some, files of a group have; a facet's common value, or that it is mixed."""
    sizes = files.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_files"),
        (F.count_distinct(F.coalesce(F.col("year").cast("string"), F.lit("-"))) > 1).alias("year_mixed"),
        F.min("year").alias("least_year"),
        (F.count_distinct(F.coalesce(F.col("quality").cast("string"), F.lit("-"))) > 1).alias("quality_mixed"),
        F.min("quality").alias("least_quality"),
    )
    each = files.select(group, F.explode(F.array_distinct("subjects")).alias("subject")).groupBy(group, "subject").agg(F.count(F.lit(1)).alias("has"))
    met = sizes.join(each, group, "left")
    pick = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col("subject"))))
    one = met.groupBy(group, "n_files", "year_mixed", "least_year", "quality_mixed", "least_quality").agg(pick(F.col("has") == F.col("n_files")).alias("in_all"), pick(F.col("has") < F.col("n_files")).alias("in_some"))
    return one.select(group, "n_files", "year_mixed", F.when(~F.col("year_mixed"), F.col("least_year")).alias("year"), "quality_mixed", F.when(~F.col("quality_mixed"), F.col("least_quality")).alias("quality"), "in_all", "in_some")


def set_signature(rows: DataFrame, column: str) -> Column:
    """An order-independent signature; of distinct values, as pairs would cancel: 60 bits of each value's MD5, combined by XOR."""
    bits = F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 15), 16, 10).cast("long")
    return rows.select(column).distinct().agg(F.bit_xor(bits).alias("signature"))


SORT_COLUMNS = {"date": "sort_date", "priority": "priority", "read_state": "read_state", "file_type": "file_type", "subjects": "first_subject"}


def sort_order(keys: list[tuple[str, bool]], tie: str = "path") -> list[Column]:
    """Order columns for (key, descending) pairs: missing last either way, natural path as the last tie-break; none for no keys."""
    made = [missing_last(natural_key(F.col("name")) if k == "name" else F.col(SORT_COLUMNS.get(k, k)), d) for k, d in keys]
    return [*made, natural_key(F.col(tie)).asc(), F.col(tie).asc()] if made else []


def suggestions(vocabulary: DataFrame, typed: str, chosen: list[str], limit: int = 8) -> DataFrame:
    """Tags that start with what is typed, then tags that contain it, each alphabetical, without the chosen ones."""
    typed = typed.strip().lower()
    low = F.lower("tag")
    found = vocabulary.where(F.contains(low, F.lit(typed)) & ~F.col("tag").isin(*chosen) if chosen else F.contains(low, F.lit(typed)))
    order = Window.orderBy("later", F.lower("tag"), "tag")
    ranked = found.withColumn("later", F.when(F.startswith(low, F.lit(typed)), 0).otherwise(1)).orderBy("later", low, "tag").limit(limit)
    return ranked.select("tag", F.row_number().over(order).cast(BIG).alias("place"))


def controlled(proposals: DataFrame, vocabulary: DataFrame, limit: int = 6) -> DataFrame:
    """Proposed tags (id, pos, tag) in canonical spelling, first proposal of each, in order, cut to the limit.

    The vocabulary (tag) is folded to lower case; of spellings that fold alike the least is canonical. With an empty one
    the first proposals stay as they are.
    """
    if vocabulary.isEmpty():
        ranked = proposals.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("pos", "tag")))
        return ranked.where(F.col("place") <= limit).select("id", F.col("tag").alias("canonical"), F.col("place").cast(BIG).alias("place"))
    known = vocabulary.groupBy(F.lower("tag").alias("key")).agg(F.min("tag").alias("canonical"))
    met = proposals.withColumn("key", F.lower(F.trim("tag"))).join(known, "key").groupBy("id", "canonical").agg(F.min("pos").alias("pos"))
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("pos", "canonical")))
    return ranked.where(F.col("place") <= limit).select("id", "canonical", F.col("place").cast(BIG).alias("place"))
