"""Queries over ordered pages: conversations stand for page sequences, orders for photos and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chunks
from quire.operators import sequence as sq
from quire.operators.chunks import Ordered
from quire.session import table

QUERIES: dict = {}
ORACLES: dict = {}

KIND = """CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN 'Box' WHEN (conv_id + turn) % 11 = 5 THEN 'Folder' WHEN (conv_id + turn) % 13 = 6 THEN NULL
WHEN role = 'user' AND turn % 3 <> 1 THEN 'Document Start' ELSE 'Continuation' END"""
BOX = "CASE WHEN (conv_id + turn) % 5 = 2 THEN concat('Box ', cast((conv_id + turn) % 4 AS string)) END"
PAGES = f"pages_in AS (SELECT conv_id % 50 AS shelf, conv_id * 1000 + turn AS seq, text, {KIND} AS classification, {BOX} AS box FROM conversations)"
MARK = "coalesce(classification IN ('Box', 'Folder'), false)"
SEGMENTS = f"""seg_in AS (SELECT *, sum(CASE WHEN {MARK} OR classification IS NULL OR classification = 'Document Start' OR before OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY shelf ORDER BY seq) - 1 AS segment
FROM (SELECT *, coalesce(lag({MARK}) OVER (PARTITION BY shelf ORDER BY seq), false) AS before, row_number() OVER (PARTITION BY shelf ORDER BY seq) AS rn FROM pages_in))"""
RUNS = """run_in AS (SELECT *, sum(CASE WHEN coalesce(classification = 'Continuation', false) AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY shelf ORDER BY seq) - 1 AS run
FROM (SELECT *, row_number() OVER (PARTITION BY shelf ORDER BY seq) AS rn FROM pages_in))"""
ROWS = "row_in AS (SELECT shelf, segment, count(*) AS n_pages, bool_or(classification IS NOT NULL AND classification IN ('Box', 'Folder')) AS is_marker, min(seq) AS first_seq, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY seq) AS text FROM seg_in GROUP BY ALL)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") % 50).alias("shelf"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.expr(KIND).alias("classification"), F.expr(BOX).alias("box"))


@query("win1_segments", f"WITH {PAGES}, {SEGMENTS}, {ROWS} SELECT shelf, segment::BIGINT AS segment, n_pages, is_marker, first_seq, md5(text) AS text_md5 FROM row_in")
def segments(spark, sf_dir):
    found = sq.segment_rows(pages(spark, sf_dir), "shelf")
    return found.select("shelf", "segment", "n_pages", "is_marker", "first_seq", F.md5("text").alias("text_md5"))


@query("win2_runs", f"WITH {PAGES}, {RUNS} SELECT shelf, seq, run::BIGINT AS run FROM run_in")
def runs(spark, sf_dir):
    return sq.runs(pages(spark, sf_dir), "shelf").select("shelf", "seq", "run")


@query("misc6_selected_runs", f"WITH {PAGES}, {RUNS} SELECT shelf, seq, run::BIGINT AS run FROM run_in WHERE (shelf, run) IN (SELECT (shelf, run) FROM run_in WHERE seq % 9 = 4)")
def selected(spark, sf_dir):
    return sq.selected_runs(pages(spark, sf_dir), "shelf", F.col("seq") % 9 == 4).select("shelf", "seq", "run")


@query(
    "win3_collections",
    f"""WITH {PAGES}, f AS (SELECT shelf, seq, coalesce(last_value(box IGNORE NULLS) OVER (PARTITION BY shelf ORDER BY seq ROWS UNBOUNDED PRECEDING),
    first_value(box IGNORE NULLS) OVER (PARTITION BY shelf ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'Uncategorized') AS collection FROM pages_in),
    g AS (SELECT *, min(seq) OVER (PARTITION BY shelf, collection) AS fs FROM f) SELECT shelf, seq, collection, dense_rank() OVER (PARTITION BY shelf ORDER BY fs) AS place FROM g""",
)
def collections(spark, sf_dir):
    return sq.collections(pages(spark, sf_dir), "shelf", F.col("box")).select("shelf", "seq", "collection", F.col("place").cast("long").alias("place"))


@query(
    "join8_as_of_box",
    f"""WITH {PAGES}, b AS (SELECT shelf, seq AS at, box AS name FROM pages_in WHERE box IS NOT NULL)
    SELECT p.shelf, p.seq, CASE WHEN p.box IS NOT NULL THEN 'key ' || (p.seq % 3) ELSE coalesce(b.name, 'key ' || (p.seq % 3)) END AS assigned FROM pages_in p ASOF LEFT JOIN b ON p.shelf = b.shelf AND p.seq >= b.at""",
)
def as_of(spark, sf_dir):
    return sq.as_of_box(pages(spark, sf_dir), "shelf", F.col("box"), F.concat(F.lit("key "), F.col("seq") % 3)).select("shelf", "seq", "assigned")


@query(
    "win4_nearby",
    f"""WITH {PAGES}, {SEGMENTS}, {ROWS} SELECT shelf, segment::BIGINT AS segment, md5(array_to_string(list_concat(coalesce(list(text[1:300]) OVER (PARTITION BY shelf ORDER BY segment ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []),
    coalesce(list(text[1:300]) OVER (PARTITION BY shelf ORDER BY segment ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []))[1:3], chr(10) || '---' || chr(10))) AS context_md5 FROM row_in""",
)
def nearby(spark, sf_dir):
    return sq.nearby(sq.segment_rows(pages(spark, sf_dir), "shelf"), "shelf").select("shelf", "segment", F.md5("context").alias("context_md5"))


@query("win5_previous_tail", f"WITH {PAGES} SELECT shelf, seq, right(lag(text) OVER (PARTITION BY shelf ORDER BY seq), 200) AS tail FROM pages_in")
def tail(spark, sf_dir):
    return sq.previous_tail(pages(spark, sf_dir), "shelf").select("shelf", "seq", "tail")


@query(
    "win6_triage",
    f"""WITH {PAGES}, h AS (SELECT shelf, seq, CASE WHEN seq % 4 = 1 THEN seq END AS hit FROM pages_in) SELECT shelf, seq,
    coalesce(first_value(hit IGNORE NULLS) OVER (PARTITION BY shelf ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(hit) OVER (PARTITION BY shelf)) AS next_wanted,
    coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY shelf ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(hit) OVER (PARTITION BY shelf)) AS previous_wanted FROM h""",
)
def triage(spark, sf_dir):
    return sq.triage(pages(spark, sf_dir), "seq", F.col("seq") % 4 == 1, "shelf").select("shelf", "seq", "next_wanted", "previous_wanted")


FIND = "(length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3"


@query(
    "win7_find_positions",
    f"""WITH p AS (SELECT conv_id, turn, unnest(range({FIND})) AS ordinal FROM conversations), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, ordinal) AS position, count(*) OVER (PARTITION BY conv_id) AS total FROM p)
    SELECT conv_id, turn, ordinal, position, total, position % total + 1 AS following, (position + total - 2) % total + 1 AS preceding FROM q""",
)
def find(spark, sf_dir):
    panes = table(spark, sf_dir, "conversations").select("conv_id", "turn", sq.occurrences(F.col("text"), "The").alias("n"))
    found = sq.find_positions(panes, "conv_id", "turn", "n")
    return found.select("conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"), *(F.col(c).cast("long").alias(c) for c in ("position", "total", "following", "preceding")))


@query(
    "win8_page_pairs",
    f"SELECT conv_id, turn, (count(*) OVER (PARTITION BY conv_id) + 1) // 2 AS n_pairs, (turn // 2)::BIGINT AS pair, turn % 2 = 0 AS is_image, {FIND} AS n_found FROM conversations",
)
def pairs(spark, sf_dir):
    counted = Ordered(table(spark, sf_dir, "conversations").withColumn("one", F.lit(1)), "conv_id", "turn").with_folds(n_pages=chunks.total(F.col("one"))).rows()
    return counted.select("conv_id", "turn", *(c.alias(k) for k, c in sq.page_pairs(F.col("turn"), F.col("n_pages")).items()), sq.occurrences(F.col("text"), "the").alias("n_found"))


@query(
    "win9_numbering",
    "SELECT o_orderkey, printf('%05d %s', (120 + row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey))::INT, o_orderpriority) AS file_name FROM orders",
)
def numbering(spark, sf_dir):
    return sq.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 120).select("o_orderkey", "file_name")


@query("agg16_highest_number", "SELECT coalesce(max(CASE WHEN regexp_matches(n, '^[0-9]{5} ') THEN substr(n, 1, 5)::INT END), 0)::BIGINT AS highest FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN printf('%05d ', p_partkey::INT) ELSE '' END || p_name AS n FROM part)")
def highest(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.expr("concat(CASE WHEN p_partkey % 3 = 0 THEN format_string('%05d ', cast(p_partkey AS int)) ELSE '' END, p_name)").alias("name"))
    return sq.highest_number(names)


@query(
    "win10_unique_names",
    "SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || ' ' || n END AS unique_name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS n FROM part)",
)
def unique(spark, sf_dir):
    return sq.unique_names(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey").select("p_partkey", "unique_name")


PHOTO = {"group_id": "o_custkey", "seq": "o_orderkey", "type": "o_orderstatus", "priority": "o_orderpriority", "year": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 1900 + o_orderkey % 80 END", "month": "CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_orderkey % 12 END"}
_PHOTOS = "p AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PHOTO.items()) + " FROM orders)"


@query(
    "agg13_capture_groups",
    f"WITH {_PHOTOS} SELECT group_id, min(seq) AS first_seq, count(*) AS n_photos, arg_min(type, seq) AS type, arg_min(priority, seq) AS priority, arg_min(year, seq) FILTER (year IS NOT NULL) AS year, arg_min(month, seq) FILTER (month IS NOT NULL) AS month FROM p GROUP BY group_id",
)
def capture(spark, sf_dir):
    return sq.capture_groups(table(spark, sf_dir, "orders").select(*(F.expr(e).alias(n) for n, e in PHOTO.items())))


@query(
    "agg15_majority_vote",
    "SELECT k, arg_max(v, (n, -v)) AS vote, max(n) AS n_votes FROM (SELECT l_orderkey AS k, l_linenumber % 4 * 90 AS v, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY k",
)
def vote(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 4 * 90).alias("v"))
    return sq.majority(votes, "k", "v")


@query(
    "agg14_history_totals",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT count(*) AS n_runs, sum(cast(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents, max(o_orderkey) AS last_key FROM o WHERE rn <= 200""",
)
def history(spark, sf_dir):
    newest = table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(200)
    return newest.agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.max("o_orderkey").alias("last_key"))
