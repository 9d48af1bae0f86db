"""The library's inputs derived from the driver's tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.facets import facets
from quire.session import table

#: Tokens of a file's tag array, in order; nulls are left out.
TOKENS = (
    "CASE WHEN doc_id % 11 = 0 THEN '1984' END",
    "CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 7 = 5 THEN concat(cast(1900 + (doc_id % 9) * 10 AS string), 's') ELSE cast(1900 + doc_id % 90 AS string) END",
    "CASE doc_id % 4 WHEN 0 THEN '03 March' WHEN 1 THEN '11 November' WHEN 2 THEN '4 March' END",
    "CASE WHEN doc_id % 8 = 0 THEN concat('Day ', cast(1 + doc_id % 28 AS string)) END",
    "source",
    "CASE WHEN doc_id % 10 < 3 THEN concat('Q', cast(1 + doc_id % 10 AS string)) WHEN doc_id % 10 = 4 THEN 'P8' WHEN doc_id % 10 = 5 THEN 'P7' WHEN doc_id % 10 = 6 THEN 'P10' WHEN doc_id % 10 = 7 THEN 'P3' END",
    "concat('Lang ', lang)",
    "CASE WHEN doc_id % 6 = 0 THEN source END",
    "CASE WHEN doc_id % 13 = 0 THEN 'Date Uncertain' END",
    "CASE doc_id % 19 WHEN 0 THEN 'Red' WHEN 1 THEN 'Purple' WHEN 2 THEN 'Red' END",
    "CASE WHEN doc_id % 21 = 0 THEN 'Q1' END",
    "CASE doc_id % 3 WHEN 0 THEN 'Read' WHEN 1 THEN 'Unread' END",
    "CASE WHEN doc_id % 17 = 0 THEN 'unread' END",
)
COLUMNS = {
    "path": "concat('/root/', source, '/', lang, '/doc_', cast(doc_id AS string), CASE WHEN doc_id % 23 = 0 THEN '.jpg' ELSE '.pdf' END)",
    "folder": "concat('/root/', source, '/', lang)",
    "name": "concat('Doc ', cast(doc_id % 700 AS string), CASE WHEN doc_id % 23 = 0 THEN '.jpg' ELSE '.pdf' END)",
    "label": "CASE doc_id % 19 WHEN 0 THEN 6 WHEN 1 THEN 3 END",
    "readable": "doc_id % 29 <> 0",
    "has_text": "doc_id % 31 <> 0",
    "mtime": "cast(doc_id * 7 % 1000 AS double)",
}
FACETS = "read_state date_uncertain quality priority year month day decade color subjects sort_date date_is_speculative display_date topical_tags".split()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with tags and facets."""
    docs = table(spark, sf_dir, "documents")
    made = docs.select("doc_id", "source", "lang", "n_chars", *(F.expr(e).alias(n) for n, e in COLUMNS.items()), F.array_compact(F.array(*map(F.expr, TOKENS))).alias("tags"))
    return made.withColumn("f", facets(F.col("tags"), F.col("label"))).select(*made.columns, *(F.col(f"f.{n}").alias(n) for n in FACETS))


_MONTH_NAMES = "['january','february','march','april','may','june','july','august','september','october','november','december']"
_SHORT = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

#: DuckDB: a CTE list that ends in `files` with the same columns.
FILES = f"""
raw_files AS (SELECT doc_id, source, lang, n_chars, {", ".join(f"{e} AS {n}" for n, e in COLUMNS.items())},
  list_filter([{", ".join(TOKENS)}], lambda t: t IS NOT NULL) AS tags FROM documents),
tokens AS (SELECT doc_id, label, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM raw_files),
kinds AS (SELECT *, CASE WHEN lower(tag) IN ('read', 'unread') THEN 'read' WHEN lower(tag) = 'date uncertain' THEN 'uncertain'
  WHEN regexp_full_match(tag, 'Q[1-3]|[Pp]([789]|10)') THEN 'rating'
  WHEN regexp_full_match(tag, '[0-9]+ [A-Za-z]+') AND list_position({_MONTH_NAMES}, lower(split_part(tag, ' ', 2))) = split_part(tag, ' ', 1)::INT THEN 'month'
  WHEN regexp_full_match(tag, '(?i)day [0-9]+') AND substr(tag, 5)::INT BETWEEN 1 AND 31 THEN 'day'
  WHEN regexp_full_match(tag, '[0-9]{{2,3}}0s') THEN 'decade' WHEN regexp_full_match(tag, '[0-9]{{3,4}}') THEN 'year'
  WHEN (label = 6 AND tag = 'Red') OR (label = 3 AND tag = 'Purple') THEN 'color' ELSE 'subject' END AS kind FROM tokens),
followed AS (SELECT *, lead(i) OVER (PARTITION BY doc_id, kind ORDER BY i) AS next_i FROM kinds),
chosen AS (SELECT doc_id, any_value(label) AS lb, lower(arg_max(tag, i) FILTER (kind = 'read')) AS read_state, coalesce(bool_or(kind = 'uncertain'), false) AS date_uncertain,
  arg_max(tag, i) FILTER (kind = 'rating') AS rt, arg_max(tag, i) FILTER (kind = 'month') AS mt, arg_max(tag, i) FILTER (kind = 'day') AS dt,
  arg_max(tag, i) FILTER (kind = 'decade') AS ct, arg_max(tag, i) FILTER (kind = 'year') AS yt, bool_or(kind = 'color') AS colored,
  coalesce(list(tag ORDER BY CASE WHEN kind = 'subject' THEN i ELSE next_i END) FILTER (kind = 'subject' OR (kind IN ('rating', 'month', 'day', 'decade', 'year') AND next_i IS NOT NULL)), []) AS subjects
  FROM followed GROUP BY doc_id),
valued AS (SELECT *, yt::INT AS year, split_part(mt, ' ', 1)::INT AS month, substr(dt, 5)::INT AS day, rtrim(ct, 's')::INT AS decade,
  CASE WHEN upper(rt[1]) = 'P' THEN substr(rt, 2)::INT ELSE substr(rt, 2)::INT + 7 END AS priority FROM chosen),
files AS (SELECT r.*, read_state, date_uncertain, CASE WHEN priority > 7 THEN priority - 7 END AS quality, priority, year, month, day, decade,
  CASE WHEN colored THEN CASE WHEN lb = 6 THEN 'box' ELSE 'folder' END END AS color, subjects,
  CASE WHEN year IS NOT NULL THEN year * 10000 + coalesce(month, 0) * 100 + coalesce(day, 0) ELSE decade * 10000 END AS sort_date,
  date_uncertain OR (year IS NULL AND decade IS NOT NULL) AS date_is_speculative,
  CASE WHEN year IS NULL THEN ct WHEN month IS NULL THEN year::VARCHAR WHEN day IS NULL THEN {_SHORT}[month] || ' ' || year ELSE {_SHORT}[month] || ' ' || day || ', ' || year END AS display_date,
  list_filter(tags, lambda t: NOT (lower(t) IN ('read', 'unread', 'date uncertain') OR coalesce(t = yt, false) OR coalesce(t = mt, false) OR coalesce(t = dt, false) OR coalesce(t = ct, false))) AS topical_tags
  FROM raw_files r JOIN valued v ON r.doc_id = v.doc_id)
"""

NATURAL = "lower(array_to_string(list_transform(regexp_extract_all({0}, '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 12, '0') ELSE p END), ''))"
