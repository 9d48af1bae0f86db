"""Queries over tag arrays as multisets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import tags as tg
from quire.plans.fixtures import FILES, files

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, f"WITH {FILES} {sql}"
        return f

    return put


def _joined(c):
    return F.array_join(c, "|")


_AFTER = "list_concat(list_filter(tags, lambda t: t <> source), [source, 'New'])"
_NTH = "len(list_filter({a}[1:i], lambda y: y = x))"


def _difference(a: str, b: str) -> str:
    return f"array_to_string(list_transform(list_filter(list_zip({a}, range(1, len({a}) + 1)), lambda z: len(list_filter({a}[1:z[2]], lambda y: y = z[1])) > len(list_filter({b}, lambda y: y = z[1]))), lambda z: z[1]), '|')"


def _edited(df):
    return df.withColumn("after", F.concat(F.filter("tags", lambda t: t != F.col("source")), F.array(F.col("source"), F.lit("New"))))


@query("set1_set_algebra", "SELECT doc_id, len(list_intersect(tags, subjects))::BIGINT AS n_both, len(list_distinct(list_concat(tags, subjects)))::BIGINT AS n_any, len(list_filter(list_distinct(tags), lambda t: NOT list_contains(subjects, t)))::BIGINT AS n_less FROM files")
def algebra(spark, sf_dir):
    n = lambda c: F.size(c).cast("long")
    return files(spark, sf_dir).select("doc_id", n(F.array_intersect("tags", "subjects")).alias("n_both"), n(F.array_union("tags", "subjects")).alias("n_any"), n(F.array_except("tags", "subjects")).alias("n_less"))


@query("set2_multiset_equal", f"SELECT doc_id, list_sort(tags) = list_sort(list_reverse(tags)) AS turned, list_sort(tags) = list_sort({_AFTER}) AS edited FROM files")
def equal(spark, sf_dir):
    f = _edited(files(spark, sf_dir))
    return f.select("doc_id", tg.multiset_equal(F.col("tags"), F.reverse("tags")).alias("turned"), tg.multiset_equal(F.col("tags"), F.col("after")).alias("edited"))


@query("set3_multiset_difference", f"SELECT doc_id, {_difference('tags', '[source]')} AS rest FROM files")
def difference(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", _joined(tg.multiset_difference(F.col("tags"), F.array("source"))).alias("rest"))


@query("set4_inverse", f"SELECT doc_id, {_difference('tags', 'after')} AS removed, {_difference('after', 'tags')} AS added FROM (SELECT *, {_AFTER} AS after FROM files)")
def inverse(spark, sf_dir):
    removed, added = tg.inverse(F.col("tags"), F.col("after"))
    return _edited(files(spark, sf_dir)).select("doc_id", _joined(removed).alias("removed"), _joined(added).alias("added"))


@query(
    "set5_delta",
    """SELECT doc_id, array_to_string(CASE WHEN o <> tags THEN o END, '|') AS edited FROM (SELECT *, list_concat(k, list_filter(['Lang en', 'Extra'], lambda t: NOT list_contains(k, t))) AS o
    FROM (SELECT *, list_filter(tags, lambda t: lower(t) <> 'read' AND t <> 'Lang fr') AS k FROM files))""",
)
def delta(spark, sf_dir):
    out = tg.apply_delta(F.col("tags"), F.array(F.lit("READ"), F.lit("Lang fr")), F.array(F.lit("Lang en"), F.lit("Extra")))
    return files(spark, sf_dir).select("doc_id", _joined(out).alias("edited"))


@query(
    "set6_occurrences",
    f"SELECT doc_id, {_difference('tags', '[source]')} || '|' || source AS edited FROM files",
)
def occurrences(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", _joined(tg.apply_occurrences(F.col("tags"), F.array("source"), F.array("source"))).alias("edited"))


@query(
    "set7_read_state",
    """SELECT doc_id, CASE WHEN read_state IS NOT NULL AND o <> tags THEN array_to_string(o, '|') END AS marked,
    CASE WHEN list_contains(tags, 'Lang de') THEN array_to_string(CASE WHEN list_contains(tags, 'Lang en') THEN list_filter(tags, lambda t: t <> 'Lang de') ELSE list_transform(tags, lambda t: CASE WHEN t = 'Lang de' THEN 'Lang en' ELSE t END) END, '|') END AS renamed
    FROM (SELECT *, list_append(list_filter(tags, lambda t: lower(t) NOT IN ('read', 'unread')), 'Read') AS o FROM files)""",
)
def read_state(spark, sf_dir):
    marked, renamed = tg.set_read_state(F.col("tags"), "Read"), tg.rename(F.col("tags"), "Lang de", "Lang en")
    return files(spark, sf_dir).select("doc_id", _joined(marked).alias("marked"), _joined(renamed).alias("renamed"))


@query(
    "set8_year_delta",
    """SELECT doc_id, array_to_string(list_filter(tags, lambda t: regexp_full_match(t, '[0-9]{3,4}') OR regexp_full_match(t, '[0-9]{2,3}0s')), '|') AS removed, (1800 + doc_id % 50)::VARCHAR AS added,
    array_to_string(list_filter(subjects, lambda t: t NOT IN ('Lang en', 'Other')), '|') AS subjects_removed FROM files""",
)
def year_delta(spark, sf_dir):
    removed, added = tg.set_year(F.col("tags"), 1800 + F.col("doc_id") % 50)
    gone, _ = tg.subject_delta(F.col("subjects"), F.array(F.lit(" Lang en "), F.lit("Other")))
    return files(spark, sf_dir).select("doc_id", _joined(removed).alias("removed"), _joined(added).alias("added"), _joined(gone).alias("subjects_removed"))


@query(
    "set9_managed_projection",
    "SELECT doc_id, array_to_string(list_concat(list_filter(tags, lambda t: t <> 'Lang en'), list_filter([source, 'Managed'], lambda t: NOT list_contains(tags, t))), '|') AS projected FROM files",
)
def managed(spark, sf_dir):
    out = tg.project_managed(F.col("tags"), F.array(F.lit("Lang en"), F.col("source")), F.array(F.col("source"), F.lit("Managed")))
    return files(spark, sf_dir).select("doc_id", _joined(out).alias("projected"))


@query(
    "fn21_reclassified",
    """SELECT doc_id, array_to_string(list_concat(['Purple', 'Folder'], list_transform(list_filter(list_zip(tags, range(1, len(tags) + 1)), lambda z: z[2] <> coalesce(list_position(list_transform(tags, lambda t: t IN ('Red', 'Purple')), true), 0)), lambda z: z[1])), '|') AS tags FROM files""",
)
def reclassified(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", _joined(tg.reclassified(F.col("tags"), F.lit("Purple"), F.lit("Folder"))).alias("tags"))


@query("fn22_ordered_for_file", "SELECT doc_id, array_to_string(list_concat(['Red'], list_filter(tags, lambda t: lower(t) <> 'unread' AND t <> 'Red'), ['Unread']), '|') AS tags FROM files")
def ordered(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", _joined(tg.ordered_for_file(F.col("tags"), F.lit("Red"))).alias("tags"))


@query(
    "misc7_near_duplicate_subjects",
    ", s AS (SELECT subject, count(*) AS n_files FROM (SELECT doc_id, unnest(list_distinct(list_append(subjects, upper(source)))) AS subject FROM files) GROUP BY subject) SELECT a.subject, b.subject AS twin, a.n_files FROM s a JOIN s b ON lower(a.subject) = lower(b.subject) AND a.subject <> b.subject",
)
def near_duplicates(spark, sf_dir):
    each = files(spark, sf_dir).select(F.explode(F.array_distinct(F.concat("subjects", F.array(F.upper("source"))))).alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n_files"))
    keyed = each.withColumn("key", F.lower("subject"))
    twins = keyed.select("key", F.col("subject").alias("twin"))
    return keyed.join(twins, "key").where("subject <> twin").select("subject", "twin", "n_files")
