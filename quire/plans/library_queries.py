"""Queries over the library of files: facets, filters, counts and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.ordering import natural_key
from quire.operators import filters as flt
from quire.operators import library as lib
from quire.operators.ranking import with_place
from quire.plans.fixtures import FILES, NATURAL, files

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, raw: bool = False):
    """Registers a query; its SQL may use the `files` CTEs unless raw."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if raw else f"WITH {FILES} {sql}"
        return f

    return put


BASE = flt.LibraryFilter(folder="/root/src1")
VIEW = flt.LibraryFilter(folder="/root", read_state="unread", subjects=("Lang en",), priorities=(8, 9, 10))
SAVED = {
    "unread_en": flt.LibraryFilter(read_state="unread", subjects=("Lang en",)),
    "any_two": flt.LibraryFilter(subjects=("src1", "src2"), match_all=False),
    "no_state": flt.LibraryFilter(read_state="none"),
    "doc_12": flt.LibraryFilter(name=" doc 12 ", needs_attention=True),
    "top": flt.LibraryFilter(folder="/root/src6/", priorities=(10,)),
}


@query("prj4_filter_names", "SELECT * FROM (VALUES ('unread_en', 'unread, Lang en'), ('any_two', 'src1, src2'), ('no_state', 'none'), ('doc_12', '\" doc 12 \"'), ('top', 'src6, P10'), ('all', 'All files')) v(filter, summary)", raw=True)
def filter_names(spark, sf_dir):
    named = SAVED | {"all": flt.LibraryFilter()}
    return spark.createDataFrame([(k, f.summary()) for k, f in named.items()], "filter string, summary string")


def _ranked(df, keys):
    return with_place(df, lib.sort_order(keys))


@query(
    "flt1_srt1_library_view",
    f"""SELECT doc_id, name, sort_date, row_number() OVER (ORDER BY sort_date ASC NULLS LAST, {NATURAL.format('name')} ASC NULLS LAST, {NATURAL.format('path')}, path) AS place
    FROM files WHERE starts_with(path, '/root/') AND read_state = 'unread' AND priority IN (8, 9, 10) AND list_contains(subjects, 'Lang en')""",
)
def view(spark, sf_dir):
    shown = files(spark, sf_dir).where(VIEW.column()).select("doc_id", "name", "path", "sort_date")
    return _ranked(shown, [("date", False), ("name", False)]).select("doc_id", "name", "sort_date", "place")


_FACET_COLUMNS = "doc_id, read_state, date_uncertain, quality, priority, year, month, day, decade, color, array_to_string(subjects, '|') AS subjects, sort_date, date_is_speculative, display_date, array_to_string(topical_tags, '|') AS topical_tags"


@query("fn1_fn2_fn3_facets", f"SELECT {_FACET_COLUMNS} FROM files")
def facet_rows(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select(
        "doc_id", "read_state", "date_uncertain", "quality", "priority", "year", "month", "day", "decade", "color",
        F.array_join("subjects", "|").alias("subjects"), "sort_date", "date_is_speculative", "display_date", F.array_join("topical_tags", "|").alias("topical_tags"),
    )


@query("src4_membership", "SELECT doc_id, len(list_filter(tags, lambda t: lower(t) IN ('read', 'unread'))) > 0 AS tracked, len(tags) > 0 AS tagged FROM files")
def membership(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", flt.tracks_read_state(F.col("tags")).alias("tracked"), flt.has_any_tag(F.col("tags")).alias("tagged"))


@query("flt1_facet_filters", "SELECT doc_id FROM files WHERE (path = '/root/src6' OR starts_with(path, '/root/src6/')) AND priority = 10")
def facet_filters(spark, sf_dir):
    return files(spark, sf_dir).where(SAVED["top"].column()).select("doc_id")


@query("flt1b_no_read_state", "SELECT doc_id FROM files WHERE read_state IS NULL")
def no_state(spark, sf_dir):
    return files(spark, sf_dir).where(SAVED["no_state"].column()).select("doc_id")


@query("flt1d_any_subject", "SELECT doc_id FROM files WHERE list_has_any(subjects, ['src1', 'src2'])")
def any_subject(spark, sf_dir):
    return files(spark, sf_dir).where(SAVED["any_two"].column()).select("doc_id")


@query("flt1e_name", "SELECT doc_id, name FROM files WHERE contains(lower(name), 'doc 12') AND (NOT readable OR NOT has_text)")
def by_name(spark, sf_dir):
    return files(spark, sf_dir).where(SAVED["doc_12"].column()).select("doc_id", "name")


@query(
    "flt2_notes_filter",
    "SELECT doc_id FROM files WHERE quality IN (1, 3) AND sort_date BETWEEN 19200000 AND 19601231 AND list_has_any(subjects, ['Lang en', 'Lang fr']) AND contains(lower(name), '1')",
)
def notes(spark, sf_dir):
    spec = flt.NotesFilter(qualities=(1, 3), date_from=19200000, date_to=19601231, tags=("Lang en", "Lang fr"), match_all=False, title="1")
    return files(spark, sf_dir).withColumns({"title": F.col("name"), "tags": F.col("subjects")}).where(spec.column()).select("doc_id")


@query("flt3_effective", "SELECT doc_id FROM files WHERE starts_with(path, '/root/src1/') AND read_state = 'unread' AND list_contains(subjects, 'Lang en')")
def effective(spark, sf_dir):
    return files(spark, sf_dir).where(SAVED["unread_en"].over(BASE).column()).select("doc_id")


@query("flt4_exclusion", "SELECT doc_id FROM files WHERE NOT starts_with(path, '/root/src1/') AND NOT starts_with(path, '/root/src2/fr/')")
def exclusion(spark, sf_dir):
    return flt.not_excluded(files(spark, sf_dir), ["/root/src1", "/root/src1/en", "/root/src2/fr"]).select("doc_id")


@query("flt5_format_status", "SELECT doc_id, CASE WHEN NOT readable THEN 'unreadable' WHEN NOT has_text THEN 'no_text_layer' ELSE 'standard' END AS status FROM files")
def status(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", flt.format_status(F.col("readable"), F.col("has_text")).alias("status"))


@query("flt7_containment", "SELECT doc_id, starts_with(path, '/root/src1/') AND NOT list_has_any(string_split(path, '/'), ['.', '..']) AS inside FROM files")
def containment(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", flt.contained(F.col("path"), F.lit("/root/src1")).alias("inside"))


@query(
    "flt8_safe_group",
    "SELECT event_id, regexp_full_match(event_type || CASE WHEN event_id % 5 = 0 THEN '..' WHEN event_id % 7 = 0 THEN '_ä-9' ELSE '' END, '[\\p{L}\\p{N}_-]{0,128}') AS safe FROM events",
    raw=True,
)
def safe_group(spark, sf_dir):
    from quire.session import table

    group = F.concat("event_type", F.expr("CASE WHEN event_id % 5 = 0 THEN '..' WHEN event_id % 7 = 0 THEN '_ä-9' ELSE '' END"))
    return table(spark, sf_dir, "events").select("event_id", flt.is_safe_group(group).alias("safe"))


@query("prj1_rows", "SELECT doc_id, name, CASE WHEN path LIKE '%.jpg' THEN 'JPG' ELSE 'PDF' END AS file_type, read_state, quality, priority, sort_date, display_date FROM files")
def shown(spark, sf_dir):
    return lib.rows(files(spark, sf_dir))


@query("agg1_subject_counts", "SELECT subject, count(*) AS n_files FROM (SELECT doc_id, unnest(list_distinct(subjects)) AS subject FROM files) GROUP BY subject")
def subject_counts(spark, sf_dir):
    return lib.subject_counts(files(spark, sf_dir))


@query(
    "agg2_tag_cloud",
    f"""SELECT subject, n_files, row_number() OVER (ORDER BY {NATURAL.format('subject')}, subject) AS place FROM (
    SELECT subject, count(*) AS n_files FROM (SELECT doc_id, unnest(list_distinct(subjects)) AS subject FROM files WHERE read_state = 'unread') GROUP BY subject)
    WHERE NOT regexp_full_match(subject, '[0-9]{{3,4}}s?') AND NOT regexp_full_match(subject, '(?i)day [0-9]+') AND NOT regexp_full_match(subject, '[0-9]+ (March|November)')""",
)
def tag_cloud(spark, sf_dir):
    return lib.tag_cloud(files(spark, sf_dir).where("read_state = 'unread'"))


@query("agg3_all_subjects", f"SELECT subject, row_number() OVER (ORDER BY {NATURAL.format('subject')}, subject) AS place FROM (SELECT DISTINCT unnest(subjects) AS subject FROM files)")
def all_subjects(spark, sf_dir):
    found = files(spark, sf_dir).select(F.explode("subjects").alias("subject")).distinct()
    return with_place(found, [natural_key(F.col("subject")), "subject"])


@query(
    "agg4_data_quality",
    """SELECT count(*) AS total, count(*) FILTER (year IS NULL) AS no_date, count(*) FILTER (priority IS NULL) AS no_priority, count(*) FILTER (date_uncertain) AS date_uncertain,
    count(*) FILTER (list_has_any(tags, ['Read']) AND list_has_any(tags, ['Unread', 'unread'])) AS both_read_unread, count(*) FILTER (color IS NOT NULL) AS markers FROM files""",
)
def data_quality(spark, sf_dir):
    return lib.data_quality(files(spark, sf_dir))


@query("agg5_attention", "SELECT count(*) FILTER (NOT readable OR NOT has_text) AS needs_attention, count(*) AS indexed FROM files WHERE starts_with(path, '/root/src1/')")
def attention(spark, sf_dir):
    return lib.attention(files(spark, sf_dir).where(BASE.column()))


@query(
    "agg6_duplicate_names",
    "SELECT doc_id, name, string_split(folder, '/')[-1] AS parent, n_same FROM (SELECT *, count(*) OVER (PARTITION BY lower(name)) AS n_same FROM files) WHERE n_same >= 2",
)
def duplicate_names(spark, sf_dir):
    return lib.duplicated_names(files(spark, sf_dir))


@query(
    "agg8_group_summary",
    """, n AS (SELECT source, count(*) AS n_files, count(DISTINCT coalesce(year::VARCHAR, '-')) > 1 AS year_mixed, min(year) AS ly, count(DISTINCT coalesce(quality::VARCHAR, '-')) > 1 AS quality_mixed, min(quality) AS lq FROM files GROUP BY source),
    s AS (SELECT source, subject, count(*) AS has FROM (SELECT source, unnest(list_distinct(subjects)) AS subject FROM files) GROUP BY ALL)
    SELECT n.source, n_files, year_mixed, CASE WHEN NOT year_mixed THEN ly END AS year, quality_mixed, CASE WHEN NOT quality_mixed THEN lq END AS quality,
    coalesce(string_agg(subject, '|' ORDER BY subject) FILTER (has = n_files), '') AS in_all, coalesce(string_agg(subject, '|' ORDER BY subject) FILTER (has < n_files), '') AS in_some
    FROM n LEFT JOIN s ON n.source = s.source GROUP BY ALL""",
)
def group_summary(spark, sf_dir):
    found = lib.group_summary(files(spark, sf_dir), "source")
    return found.withColumns({c: F.array_join(c, "|") for c in ("in_all", "in_some")})


@query(
    "agg9_folder_counts",
    """SELECT folder, count(*) AS n_files FROM (SELECT unnest(['/root', '/root/' || source, folder]) AS folder FROM files) GROUP BY folder""",
)
def folder_counts(spark, sf_dir):
    return lib.folder_counts(files(spark, sf_dir))


@query(
    "agg11_saved_filters",
    """SELECT count(*) FILTER (read_state = 'unread' AND list_contains(subjects, 'Lang en')) AS unread_en, count(*) FILTER (list_has_any(subjects, ['src1', 'src2'])) AS any_two,
    count(*) FILTER (read_state IS NULL) AS no_state, count(*) FILTER (contains(lower(name), 'doc 12')) AS doc_12, count(*) FILTER (starts_with(path, '/root/src6/') AND priority = 10) AS top FROM files""",
)
def saved_counts(spark, sf_dir):
    return lib.saved_filter_counts(files(spark, sf_dir), SAVED)


@query("agg17_set_signature", "SELECT bit_xor(('0x' || substr(md5(subject), 1, 15))::BIGINT) AS signature FROM (SELECT DISTINCT unnest(subjects) AS subject FROM files)")
def signature(spark, sf_dir):
    return lib.set_signature(files(spark, sf_dir).select(F.explode("subjects").alias("subject")), "subject")


@query("agg21_vocabulary", "SELECT DISTINCT trim(unnest(subjects)) AS tag FROM files ORDER BY tag LIMIT 50000")
def vocabulary(spark, sf_dir):
    return files(spark, sf_dir).select(F.explode("subjects").alias("tag")).select(F.trim("tag").alias("tag")).distinct().orderBy("tag").limit(50_000)


@query(
    "srt1_multi_key",
    f"SELECT doc_id, row_number() OVER (ORDER BY priority DESC NULLS LAST, read_state ASC NULLS LAST, {NATURAL.format('path')}, path) AS place FROM files",
)
def multi_key(spark, sf_dir):
    return _ranked(files(spark, sf_dir).select("doc_id", "path", "priority", "read_state"), [("priority", True), ("read_state", False)]).select("doc_id", "place")


@query("srt2_notes_sort", f"SELECT doc_id, row_number() OVER (ORDER BY quality DESC NULLS LAST, {NATURAL.format('name')}, doc_id) AS place FROM files")
def notes_sort(spark, sf_dir):
    rows = files(spark, sf_dir).select("doc_id", "quality", "name")
    return with_place(rows, [F.col("quality").desc_nulls_last(), natural_key(F.col("name")), F.col("doc_id")]).select("doc_id", "place")


@query("srt4_natural_key", f"SELECT doc_id, {NATURAL.format('name')} AS natural_name FROM files")
def natural(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", natural_key(F.col("name")).alias("natural_name"))


@query(
    "top3_suggestions",
    """, v AS (SELECT DISTINCT unnest(subjects) AS tag FROM files), r AS (SELECT tag, CASE WHEN starts_with(lower(tag), 'src1') THEN 0 ELSE 1 END AS later FROM v WHERE contains(lower(tag), 'src1') AND tag <> 'src1')
    SELECT tag, row_number() OVER (ORDER BY later, lower(tag), tag) AS place FROM r ORDER BY place LIMIT 8""",
)
def suggestions(spark, sf_dir):
    vocabulary = files(spark, sf_dir).select(F.explode("subjects").alias("tag")).distinct()
    return lib.suggestions(vocabulary, "Src1", ["src1"])


@query(
    "top4_controlled_vocabulary",
    """, p AS (SELECT doc_id AS id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM files),
    v AS (SELECT lower(t) AS key, min(t) AS canonical FROM (SELECT DISTINCT unnest(subjects) AS t FROM files WHERE doc_id % 2 = 0) GROUP BY 1),
    m AS (SELECT id, canonical, min(pos) AS pos FROM p JOIN v ON lower(trim(tag)) = key GROUP BY ALL)
    SELECT id, canonical, row_number() OVER (PARTITION BY id ORDER BY pos, canonical) AS place FROM m QUALIFY place <= 6""",
)
def controlled(spark, sf_dir):
    f = files(spark, sf_dir)
    proposals = f.select(F.col("doc_id").alias("id"), F.posexplode("tags").alias("pos", "tag"))
    return lib.controlled(proposals, f.where("doc_id % 2 = 0").select(F.explode("subjects").alias("tag")).distinct())
