"""Queries of scalar functions, parsers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import dates as dt
from quire.functions import text as tx
from quire.operators import chunks, estimates
from quire.operators.ranking import with_place_in
from quire.plans.fixtures import FILES, files
from quire.sources import files as src
from quire.sources import trees
from quire.sources import headers, links, markdown, relay
from quire.session import shared_folder, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("$FILES", FILES)
        return f

    return put


DATE = """CASE doc_id % 6 WHEN 0 THEN cast(1500 + doc_id % 500 AS string) WHEN 1 THEN concat(cast(1500 + doc_id % 500 AS string), '-', cast(doc_id % 15 AS string)) WHEN 2 THEN concat(cast(1500 + doc_id % 500 AS string), '-2-', cast(25 + doc_id % 6 AS string))
WHEN 3 THEN concat(cast(1500 + doc_id % 500 AS string), '-11-', cast(doc_id % 33 AS string)) WHEN 4 THEN 'undated' END"""
PRECISION = "CASE doc_id % 5 WHEN 0 THEN 'decade' WHEN 1 THEN 'year' WHEN 2 THEN 'month' WHEN 3 THEN 'day' END"
_D = f"""d AS (SELECT doc_id, {DATE} AS date, {PRECISION} AS precision FROM documents), p AS (SELECT *, try_cast(split_part(date, '-', 1) AS INT) AS y, try_cast(split_part(date, '-', 2) AS INT) AS m, try_cast(split_part(date, '-', 3) AS INT) AS dd, try_cast(date AS INT) AS alone FROM d)"""
_DAYS = "CASE WHEN m = 2 THEN CASE WHEN (y < 1582 AND y % 4 = 0) OR (y >= 1582 AND y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)) THEN 29 ELSE 28 END WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m BETWEEN 1 AND 12 THEN 31 END"


def _dated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(DATE).alias("date"), F.expr(PRECISION).alias("precision"))


@query("fn4_item_sort_date", f"WITH {_D} SELECT doc_id, CASE precision WHEN 'decade' THEN alone * 10000 WHEN 'month' THEN y * 10000 + m * 100 WHEN 'day' THEN y * 10000 + m * 100 + dd ELSE alone * 10000 END AS sort_date FROM p")
def sort_date(spark, sf_dir):
    return _dated(spark, sf_dir).select("doc_id", dt.item_sort_date(F.col("date"), F.col("precision")).alias("sort_date"))


@query(
    "fn5_normalized_date",
    f"""WITH {_D}, v AS (SELECT *, CASE WHEN m BETWEEN 1 AND 12 THEN m END AS vm, CASE WHEN dd BETWEEN 1 AND {_DAYS} THEN dd END AS vd FROM p)
    SELECT doc_id, CASE WHEN y > 0 THEN CASE WHEN precision = 'decade' THEN (y // 10 * 10)::VARCHAR WHEN precision = 'day' AND vm IS NOT NULL AND vd IS NOT NULL THEN y || '-' || lpad(vm::VARCHAR, 2, '0') || '-' || lpad(vd::VARCHAR, 2, '0')
    WHEN precision IN ('month', 'day') AND vm IS NOT NULL THEN y || '-' || lpad(vm::VARCHAR, 2, '0') ELSE y::VARCHAR END END AS date,
    CASE WHEN y > 0 THEN CASE WHEN precision = 'decade' THEN 'decade' WHEN precision = 'day' AND vm IS NOT NULL AND vd IS NOT NULL THEN 'day' WHEN precision IN ('month', 'day') AND vm IS NOT NULL THEN 'month' ELSE 'year' END END AS precision FROM v""",
)
def normalized(spark, sf_dir):
    d = _dated(spark, sf_dir).withColumn("n", dt.normalized_date(F.col("date"), F.col("precision")))
    return d.select("doc_id", F.col("n.date").alias("date"), F.col("n.precision").alias("precision"))


@query("fn6_days_in_month", f"WITH v AS (SELECT o_orderkey, (1400 + o_orderkey % 700)::INT AS y, (o_orderkey % 14)::INT AS m FROM orders) SELECT o_orderkey, {_DAYS} AS days FROM v")
def days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dt.days_in_month(1400 + F.col("o_orderkey") % 700, F.col("o_orderkey") % 14).alias("days"))


MONTH_TEXT = "CASE doc_id % 5 WHEN 0 THEN '03 March' WHEN 1 THEN cast(doc_id % 14 AS string) WHEN 2 THEN 'late october' WHEN 3 THEN 'none' END"
DAY_TEXT = "CASE doc_id % 4 WHEN 0 THEN concat('Day ', cast(doc_id % 40 AS string)) WHEN 1 THEN cast(doc_id % 33 AS string) WHEN 2 THEN 'unknown' END"


@query(
    "fn7_machine_date",
    f"""WITH v AS (SELECT doc_id, {MONTH_TEXT} AS mt, {DAY_TEXT} AS dt FROM documents), w AS (SELECT *, CASE WHEN try_cast(substr(mt, 1, 2) AS INT) BETWEEN 1 AND 12 THEN try_cast(substr(mt, 1, 2) AS INT) WHEN mt = 'late october' THEN 10 END AS m,
    CASE WHEN try_cast(regexp_replace(dt, '[^0-9]', '', 'g') AS INT) BETWEEN 1 AND 31 THEN try_cast(regexp_replace(dt, '[^0-9]', '', 'g') AS INT) END AS d FROM v)
    SELECT doc_id, m AS month, d AS day, CASE WHEN doc_id % 9 <> 0 THEN (1900 + doc_id % 90) || CASE WHEN m IS NULL THEN '' WHEN d IS NULL THEN printf('-%02d', m) ELSE printf('-%02d-%02d', m, d) END END AS machine_date FROM w""",
)
def machine(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(MONTH_TEXT).alias("m"), F.expr(DAY_TEXT).alias("d"), F.expr("CASE WHEN doc_id % 9 <> 0 THEN cast(1900 + doc_id % 90 AS string) END").alias("y"))
    return d.select("doc_id", dt.month_number(F.col("m")).alias("month"), dt.day_number(F.col("d")).alias("day"), dt.machine_date(F.col("y"), F.col("m"), F.col("d")).alias("machine_date"))


@query("fn8_capitalize", "SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END || w[2:]), ' ') AS capitalized FROM documents")
def capitalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.capitalize_first_letters(F.col("text")).alias("capitalized"))


@query("fn9_all_tags", "SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'OCR Failed' ELSE array_to_string(list_concat(list_filter([CASE WHEN doc_id % 3 > 0 THEN '1950' END, CASE WHEN doc_id % 4 > 0 THEN '03 March' END, CASE WHEN doc_id % 5 = 0 THEN 'Date Uncertain' END], lambda x: x IS NOT NULL), [source, lang], list_filter([CASE WHEN doc_id % 2 = 0 THEN 'Letter' END], lambda x: x IS NOT NULL)), '|') END AS tags FROM documents")
def all_tags(spark, sf_dir):
    when = lambda c, v: F.when(F.expr(c), v)
    made = tx.all_tags(when("doc_id % 3 > 0", "1950"), when("doc_id % 4 > 0", "03 March"), F.lit(None).cast("string"), F.expr("doc_id % 5 = 0"), F.array("source", "lang"), when("doc_id % 2 = 0", "Letter"), F.expr("doc_id % 20 = 0"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(made, "|").alias("tags"))


RAW_NAME = "concat(CASE WHEN p_partkey % 3 = 0 THEN 'the ' ELSE 'papers of  ' END, p_name, CASE p_partkey % 4 WHEN 0 THEN ' & sons' WHEN 1 THEN ' #4' WHEN 2 THEN ' At The END' ELSE ' a/b' END)"
_SMALL = "('of', 'the', 'and', 'in', 'for', 'to', 'a', 'an', 'on', 'at', 'by')"


@query(
    "fn10_collection_name",
    f"""WITH n AS (SELECT p_partkey, string_split(regexp_replace(replace(replace(replace(replace({RAW_NAME}, '&', 'and'), '/', 'and'), '#', 'Number '), '@', 'at'), ' +', ' ', 'g'), ' ') AS w FROM part)
    SELECT p_partkey, array_to_string(list_transform(list_zip(w, range(len(w))), lambda z: CASE WHEN z[2] > 0 AND lower(z[1]) IN {_SMALL} THEN lower(z[1]) ELSE upper(z[1][1]) || lower(z[1][2:]) END), ' ') AS collection FROM n""",
)
def collection_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.collection_name(F.expr(RAW_NAME)).alias("collection"))


@query(
    "fn11_cluster_repair",
    """SELECT p_partkey, first_value(p_type) OVER (PARTITION BY lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) ORDER BY p_partkey) AS canonical FROM part""",
)
def cluster_repair(spark, sf_dir):
    keyed = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")).alias("key"))
    return chunks.Ordered(keyed, "key", "p_partkey").with_folds(canonical=chunks.first_known(F.col("p_type"))).rows().select("p_partkey", "canonical")


@query("fn13_word_diff")
def word_diff(spark, sf_dir):
    """Each text against itself with its first two threes of words exchanged, two words more, two fewer, and TH for th."""
    ws = F.split(F.trim(F.coalesce("text", F.lit(""))), "\\s+")
    moved = F.concat(F.slice(ws, 4, 3), F.slice(ws, 1, 3), F.array(F.lit("more"), F.lit("words")), F.slice(ws, F.lit(9), F.greatest(F.size(ws) - 8, F.lit(0))))
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.regexp_replace(F.array_join(moved, " "), "(?i)\\bth(\\w)", "TH$1").alias("other"))
    return d.select("conv_id", "turn", tx.word_diff("text", "other").alias("d")).select("conv_id", "turn", "d.*")


RAW_COPY = "concat('  ', substr(text, 1, 40), '-', chr(10), substr(text, 41, 30), ' ', chr(13), chr(10), ' ', chr(13), chr(10), chr(9), substr(text, 71), chr(10))"


@query("fn14_clean_copied")
def cleaned(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_copied(F.expr(RAW_COPY.replace("chr(", "char("))).alias("cleaned"))


RESPONSE = "concat(CASE doc_id % 5 WHEN 0 THEN '[box_label]' WHEN 1 THEN '[DOCUMENT START]' WHEN 2 THEN '[folder label]' WHEN 3 THEN 'note' ELSE '[document_continuation]' END, char(10), CASE doc_id % 3 WHEN 0 THEN '[rotate_90]' WHEN 1 THEN '' ELSE '[rotate 180]' END, char(10), 'Body ', doc_id)"


@query(
    "fn16_parse_response",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'box' WHEN 1 THEN 'start' WHEN 2 THEN 'folder' WHEN 4 THEN 'continuation' END AS classification, CASE doc_id % 3 WHEN 0 THEN 90 WHEN 1 THEN 0 ELSE 180 END AS rotation,
    CASE WHEN doc_id % 5 = 3 AND doc_id % 3 = 1 THEN 'note' || chr(10) || chr(10) || 'Body ' || doc_id ELSE 'Body ' || doc_id END AS body FROM documents""",
)
def parsed_response(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.parse_response(F.expr(RESPONSE)).alias("r"))
    return d.select("doc_id", F.col("r.classification").alias("classification"), F.col("r.rotation").alias("rotation"), F.col("r.text").alias("body"))


TAG_RESPONSE = """concat('```json', char(10), '{"year": ', CASE WHEN doc_id % 2 = 0 THEN '1968' ELSE '"1971"' END, ', "month": ', CASE WHEN doc_id % 3 = 0 THEN '3' ELSE '"June"' END, ', "day": "Day ', doc_id % 28 + 1, '", "date_uncertain": ', doc_id % 4 = 0, ', "subject_tags": ["a", "b"], "format": "Letter"}', char(10), '```')"""


@query(
    "fn17_tag_response",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '1968' ELSE '1971' END AS year, CASE WHEN doc_id % 3 = 0 THEN '03 March' ELSE '06 June' END AS month, 'Day ' || (doc_id % 28 + 1) AS day, doc_id % 4 = 0 AS date_uncertain, 'a|b' AS subject_tags, 'Letter' AS format FROM documents",
)
def tag_response(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.parse_tag_response(F.expr(TAG_RESPONSE)).alias("r")).select("doc_id", "r.*")
    return d.withColumn("subject_tags", F.array_join("subject_tags", "|"))


@query(
    "fn18_relay_fingerprint",
    """SELECT event_id, substr(sha256('{' || CASE WHEN month(ts) > 6 THEN '"month":"' || month(ts) || '",' ELSE '' END || '"priority":"P' || (7 + user_id % 4) || '","type":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"year":"' || year(ts) || '"' ELSE '' END || '}'), 1, 16) AS fp FROM events""",
)
def relay_fingerprint(spark, sf_dir):
    fp = relay.fingerprint(F.col("event_type"), F.concat(F.lit("P"), 7 + F.col("user_id") % 4), F.when(F.col("event_id") % 2 == 0, F.year("ts")).cast("string"), F.when(F.month("ts") > 6, F.month("ts")).cast("string"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", fp.alias("fp"))


@query("fn19_run_fingerprint", "SELECT o_custkey, sha256('opts' || chr(10) || string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)) AS fp FROM orders GROUP BY o_custkey")
def run_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("paths")).select("o_custkey", relay.run_fingerprint(F.col("paths"), F.lit("opts")).alias("fp"))


@query("fn24_extract_title")
def titles(spark, sf_dir):
    made = F.concat(F.lit("\n\n## **"), F.left("text", F.lit(30)), F.lit("** [link](x) "), F.expr("substring(text, 31)"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.title_of(made).alias("title"))


@query("fn25_image_references", "SELECT doc_id, 'a [' || doc_id || ']' AS alt, 'img(' || lang || ').png' AS target FROM documents")
def images(spark, sf_dir):
    made = tx.image_reference(F.concat(F.lit("a ["), "doc_id", F.lit("]")), F.concat(F.lit("img("), "lang", F.lit(").png")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.image_references(F.concat(F.lit("text "), made, F.lit(" more")))).alias("i"))
    return d.select("doc_id", F.col("i.alt").alias("alt"), F.col("i.target").alias("target"))


@query("fn26_backoff", "SELECT l_orderkey, l_linenumber, least(60.0, greatest(least(30.0, 1.5 * pow(2.0, l_linenumber - 1)) * 1.25, l_quantity))::DOUBLE AS seconds FROM lineitem")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.backoff(F.col("l_linenumber"), 0.5, F.col("l_quantity")).alias("seconds"))


@query("agg18_source_notes", "SELECT conv_id, count(DISTINCT turn % 3) FILTER (role = 'user') AS n_sources FROM conversations GROUP BY conv_id")
def source_notes(spark, sf_dir):
    target = F.when(F.col("role") == "user", F.col("turn") % 3)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_distinct(target).alias("n_sources"))


@query("agg19_agg20_estimates", estimates.ORACLE)
def estimate(spark, sf_dir):
    n = F.col("o_orderkey") % 500
    made = estimates.cost(n, F.lit(3.0), F.lit(15.0), image_tokens=6000, tagging=True, collections=True)
    took = estimates.seconds(n, workers=4, speed=1.6, tagging=True, collections=True)
    both = {f"{k}_cost": c for k, c in made.items()} | {f"{k}_seconds": c for k, c in took.items()}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(F.round(c, 6).alias(k) for k, c in both.items()))


@query(
    "misc1_ordered_groups",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS boundary FROM orders)
    SELECT o_orderkey, boundary, CASE WHEN o_orderkey % 10 = 0 THEN 'P10' ELSE coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'P9' END, 'P' || (7 + o_orderkey % 2)) END AS priority, coalesce(CASE WHEN o_custkey % 4 = 0 THEN 1968 END, 1900 + o_orderkey % 90)::BIGINT AS year FROM p""",
)
def ordered_groups(spark, sf_dir):
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) == 1
    page, operator, phone = F.when(F.col("o_orderkey") % 10 == 0, "P10"), F.when(F.col("o_custkey") % 3 == 0, "P9"), F.concat(F.lit("P"), 7 + F.col("o_orderkey") % 2)
    year = F.coalesce(F.when(F.col("o_custkey") % 4 == 0, F.lit(1968)), 1900 + F.col("o_orderkey") % 90)
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("boundary"), F.coalesce(page, operator, phone).alias("priority"), year.cast("long").alias("year"))


@query(
    "misc2_override_tags",
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 1999 END, 1900 + o_orderkey % 90)::BIGINT AS year, CASE WHEN o_custkey % 3 = 0 THEN false ELSE o_orderkey % 2 = 0 END AS date_uncertain FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def overridden(spark, sf_dir):
    segments = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (1900 + F.col("o_orderkey") % 90).alias("made"), F.when(F.col("o_custkey") % 3 == 0, F.lit(1999)).alias("phone"))
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(segments, "l_orderkey")
    return pages.select("l_orderkey", "l_linenumber", F.coalesce("phone", "made").cast("long").alias("year"), F.when(F.col("phone").isNotNull(), False).otherwise(F.col("l_orderkey") % 2 == 0).alias("date_uncertain"))


@query(
    "misc4_resume_outputs",
    """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'kept/' || o_orderkey END AS saved, o_orderpriority AS base FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY base, saved IS NULL ORDER BY o_orderkey) AS n FROM p)
    SELECT o_orderkey, coalesce(saved, CASE WHEN n = 1 THEN base ELSE base || ' ' || n END) AS output FROM r""",
)
def resume(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("kept/"), "o_orderkey")).alias("saved"), F.col("o_orderpriority").alias("base"))
    numbered = with_place_in(p.withColumn("same", F.when(F.col("saved").isNull(), F.col("base"))), "same", ["o_orderkey"], "n")
    return numbered.select("o_orderkey", F.coalesce("saved", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws(" ", "base", "n"))).alias("output"))


@query("misc5_pending_group", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderkey LIMIT 1")
def pending(spark, sf_dir):
    resolved = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(resolved, "o_orderkey", "left_anti").orderBy("o_orderkey").limit(1)


@query("misc10_misc11_harvest", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey = 7 DESC, c_custkey) AS place FROM customer WHERE (c_custkey % 3 = 0 OR (c_custkey = 7 AND c_custkey % 50 >= 5)) AND lower(c_mktsegment) NOT IN ('machinery', 'household')")
def harvest(spark, sf_dir):
    from quire.operators.ranking import with_place

    current = F.col("c_custkey") == 7
    due = (F.col("c_custkey") % 3 == 0) | (current & (F.col("c_custkey") % 50 >= 5))
    kept = table(spark, sf_dir, "customer").where(due & ~F.lower("c_mktsegment").isin("machinery", "household"))
    return with_place(kept, [current.desc(), F.col("c_custkey")]).select("c_custkey", "place")


LABEL = "concat(char(10), '  ', CASE WHEN p_partkey % 9 = 0 THEN '...' ELSE concat(p_name, '/', p_brand) END, '  ', char(10), 'more')"


@query("misc12_candidate_name", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Untitled' ELSE substr(replace(p_name || '/' || p_brand, '/', '-'), 1, 80) END AS candidate FROM part")
def candidate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.candidate_name(F.expr(LABEL)).alias("candidate"))


@query("misc13_misc15_scope", "WITH $FILES SELECT doc_id, CASE WHEN starts_with(folder, '/root/src1/') THEN folder END AS scope, doc_id % 2 = 0 AS temporary FROM files")
def scope(spark, sf_dir):
    from quire.operators.filters import is_temporary_sibling, sanitized_scope

    name = F.concat("path", F.when(F.col("doc_id") % 2 == 0, ".sb-0a1B2c3D-aZ09xY").otherwise(".sb-0a1B2c3D-aZ09x"))
    return files(spark, sf_dir).select("doc_id", sanitized_scope(F.col("folder"), F.lit("/root/src1")).alias("scope"), is_temporary_sibling(name).alias("temporary"))


@query("misc14_annotations", "WITH $FILES, n AS (SELECT path, max(doc_id % 4 = 0) AS flagged FROM files WHERE doc_id % 3 = 0 GROUP BY path) SELECT doc_id, coalesce(flagged, false) AS flagged FROM files LEFT JOIN n ON n.path = files.path")
def annotations(spark, sf_dir):
    f = files(spark, sf_dir)
    notes = f.where("doc_id % 3 = 0").groupBy("path").agg(F.max(F.expr("doc_id % 4 = 0")).alias("flagged"))
    return f.select("doc_id", "path").join(notes, "path", "left").select("doc_id", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query("misc16_stable_root", "SELECT o_orderkey, o_orderkey % 7 <> 0 AS stable FROM orders")
def stable(spark, sf_dir):
    before = F.struct(F.col("o_custkey").alias("inode"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("device"))
    after = F.struct(F.when(F.col("o_orderkey") % 7 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("inode"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("device"))
    return table(spark, sf_dir, "orders").select("o_orderkey", before.eqNullSafe(after).alias("stable"))


@query("src3_inspect", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'vanished' WHEN o_orderkey % 7 = 0 THEN 'symlink' WHEN o_orderkey % 5 = 0 THEN 'directory' WHEN o_orderkey % 13 = 0 THEN 'nonRegular' WHEN o_orderkey % 17 = 0 THEN 'unreadable' WHEN o_orderstatus = 'F' THEN 'tracked' ELSE 'untracked' END AS kind FROM orders")
def inspected(spark, sf_dir):
    e = F.expr
    kind = src.inspect(e("o_orderkey % 11 <> 0"), e("o_orderkey % 5 = 0"), e("o_orderkey % 7 = 0"), e("o_orderkey % 13 <> 0"), e("o_orderkey % 17 <> 0"), e("o_orderstatus = 'F'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


NOTE = """concat('---', char(10), 'id: ', doc_id, char(10), 'title: "Doc ', doc_id, '"', char(10), 'tags: [', lang, ', ', source, ']', char(10), 'quality: ', doc_id % 5, char(10), 'x_own: kept', char(10), '---', char(10),
'lead', char(10), '<!-- block:reader-page link="a b" page=', doc_id % 9, ' extra=1 -->', char(10), 'quoted ', doc_id, char(10))"""


@query("src10_src11_notes", "SELECT doc_id, doc_id::VARCHAR AS id, 'Doc ' || doc_id AS title, lang || '|' || source AS tags, (doc_id % 5)::INT AS quality, 'x_own' AS unknown_key, 2::BIGINT AS n_blocks, (doc_id % 9)::INT AS page, 'a b' AS link, 'extra' AS block_key FROM documents")
def notes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", markdown.front_matter(F.expr(NOTE)).alias("n")).withColumn("b", markdown.blocks("n.body"))
    second = F.element_at("b", 2)
    return d.select(
        "doc_id", F.col("n.id").alias("id"), F.col("n.title").alias("title"), F.array_join("n.tags", "|").alias("tags"), F.col("n.quality").alias("quality"), F.col("n.unknown")[0]["key"].alias("unknown_key"),
        F.size("b").cast("long").alias("n_blocks"), second["page"].alias("page"), second["link"].alias("link"), second["unknown"][0]["key"].alias("block_key"),
    )


@query("src9_classification", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS classification, 'Body ' || doc_id AS body FROM documents")
def classification(spark, sf_dir):
    page = F.expr("concat('Extracted text.', char(10), 'scan 1.jpg', char(10), 'A · B · 2026', char(10), CASE WHEN doc_id % 3 = 0 THEN concat('  Classification:  ', source, ' ') ELSE 'Classification:' END, char(10), char(10), 'Body ', doc_id)")
    return table(spark, sf_dir, "documents").select("doc_id", tx.classification_line(page).alias("classification"), markdown.stripped(page).alias("body"))


@query(
    "src12_jsonl",
    "SELECT conv_id::VARCHAR AS custom_id, CASE WHEN max(turn) % 3 < 2 THEN 'T' || max(turn) END AS text, CASE WHEN max(turn) % 3 = 2 THEN 'bad' END AS error FROM conversations GROUP BY conv_id",
)
def jsonl(spark, sf_dir):
    line = """CASE turn % 3 WHEN 0 THEN concat('{"custom_id":"', conv_id, '","response":{"body":{"choices":[{"message":{"content":"T', turn, '"}}]}}}')
    WHEN 1 THEN concat('{"key":"', conv_id, '","response":{"candidates":[{"content":{"parts":[{"text":"T', turn, '"}]}}]}}') ELSE concat('{"custom_id":"', conv_id, '","error":{"message":"bad"}}') END"""
    c = table(spark, sf_dir, "conversations")
    good = c.select(F.expr(line).alias("value"), F.col("turn").alias("n"))
    return src.parse_jsonl(good.unionByName(c.select(F.lit("{broken").alias("value"), F.lit(99).alias("n"))))


@query(
    "src13_relay_objects",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'receipt' WHEN 2 THEN 'segment-complete' WHEN 3 THEN 'media' ELSE 'epoch' END AS kind, CASE WHEN event_id % 5 IN (0, 1, 3) THEN 'g' || user_id END AS grp, CASE WHEN event_id % 5 IN (0, 1, 3) THEN (event_id % 100)::INT END AS seq, (event_id % 100)::VARCHAR AS parsed_seq FROM events",
)
def relay_objects(spark, sf_dir):
    name = F.expr("CASE event_id % 5 WHEN 0 THEN concat('g', user_id, '__', event_id % 100, '.json') WHEN 1 THEN concat('g', user_id, '__', event_id % 100, '.receipt.json') WHEN 2 THEN concat('g', user_id, '.segment.json') WHEN 3 THEN concat('g', user_id, '__', event_id % 100, '.JPG') ELSE '_epoch.json' END")
    e = table(spark, sf_dir, "events").select("event_id", relay.classify(name).alias("kind"), relay.identity(name).alias("i"), relay.parse(F.expr("concat('{\"seq\":', event_id % 100, '}')"))["seq"].alias("parsed_seq"))
    return e.select("event_id", "kind", F.col("i.group").alias("grp"), F.col("i.seq").alias("seq"), "parsed_seq")


@query(
    "src16_segment_json",
    """SELECT conv_id, '{"date":"1968","subjects":["Cold War","Joel DEAN"],"body":"' || string_agg('[Image: ' || turn || '.jpg]\\n' || role, '\\n\\n' ORDER BY turn) || '"}' AS json FROM conversations GROUP BY conv_id""",
)
def segment_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("turn", F.lit(".jpg")).alias("file"), F.col("role").alias("text")))).alias("pages"))
    return c.select("conv_id", src.segment_json(F.lit("1968"), F.array(F.lit("cold war"), F.lit("joel DEAN")), F.col("pages")).alias("json"))


@query("src18_accepted", "WITH $FILES SELECT doc_id, doc_id % 7 IN (0, 1, 5) AS accepted, path LIKE '%.jpg' OR path LIKE '%.pdf' AS as_it_is FROM files")
def accepted(spark, sf_dir):
    """Paths with further endings, of which some are accepted."""
    ending = F.element_at(F.array(*map(F.lit, (".PDF", ".heic", ".txt", ".d/none", ".pdf.bak", ".Jpeg", "."))), (F.col("doc_id") % 7 + 1).cast("int"))
    return files(spark, sf_dir).select("doc_id", src.accepted(F.concat("path", ending)).alias("accepted"), src.accepted(F.col("path")).alias("as_it_is"))


GUID = "concat('0a1b2c3d-0000-4000-8000-', lpad(cast(doc_id AS string), 12, '0'))"


@query("src19_durable_links", f"WITH $FILES SELECT doc_id, CASE WHEN doc_id % 6 <> 5 THEN 'reader' END AS kind, CASE WHEN doc_id % 6 <> 5 THEN {GUID} END AS root, CASE WHEN doc_id % 6 <> 5 THEN 'a b/' || name END AS rel, CASE WHEN doc_id % 6 <> 5 AND doc_id % 3 = 0 THEN (doc_id % 40 + 1)::INT END AS page FROM files")
def durable(spark, sf_dir):
    rel = F.when(F.col("doc_id") % 6 == 5, "../up").otherwise(F.concat(F.lit("a b/"), "name"))
    url = links.reader_link(F.upper(F.expr(GUID)), rel, F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 40 + 1))
    d = files(spark, sf_dir).select("doc_id", links.parse_link(url).alias("l"))
    return d.select("doc_id", *(F.col(f"l.{c}").alias(c) for c in ("kind", "root", "rel", "page")))


@query(
    "src20_references",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'group' END AS library, CASE WHEN doc_id % 2 = 1 THEN doc_id::VARCHAR END AS grp, printf('%08X', doc_id) AS key, CASE doc_id % 4 WHEN 0 THEN '1968-03-07' WHEN 1 THEN '1968-03' WHEN 2 THEN '1968' ELSE '1971' END AS date, CASE doc_id % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS precision, 'Doe, Jane|UN' AS authors FROM documents",
)
def references(spark, sf_dir):
    url = F.expr("concat(CASE WHEN doc_id % 2 = 0 THEN 'zotero://select/library/items/' ELSE concat('zotero://select/groups/', doc_id, '/items/') END, lpad(hex(doc_id), 8, '0'))")
    record = F.expr("""concat('{"author":[{"family":"Doe","given":"Jane"},{"literal":"UN"}],"issued":', CASE doc_id % 4 WHEN 0 THEN '{"date-parts":[[1968,3,7]]}' WHEN 1 THEN '{"date-parts":[["1968",3]]}' WHEN 2 THEN '{"date-parts":[[1968]]}' ELSE '{"raw":"c. 1971?"}' END, '}')""")
    d = table(spark, sf_dir, "documents").select("doc_id", links.parse_select_link(url).alias("l"), links.csl_date(record).alias("d"), F.array_join(links.csl_authors(record), "|").alias("authors"))
    return d.select("doc_id", F.col("l.library").alias("library"), F.col("l.group").alias("grp"), F.col("l.key").alias("key"), F.col("d.date").alias("date"), F.col("d.precision").alias("precision"), "authors")


_TITLE = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('T', cast(doc_id % 5 AS string)) END"
_FETCHED = "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('T', cast(doc_id % 4 AS string)) END"


@query(
    "fn27_fill_plan",
    f"""WITH v AS (SELECT doc_id, {_TITLE} AS t, {_FETCHED} AS n, lang AS d, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE '' END AS nd FROM documents), w AS (SELECT *, n IS NOT NULL AND n <> '' AND n <> t AS ct, nd <> '' AND nd <> d AS cd FROM v)
    SELECT doc_id, ct::INT + cd::INT AS n_changes, coalesce(ct AND t <> '', false) AS replaces_title, CASE WHEN ct THEN n ELSE t END AS title, d AS date FROM w""",
)
def fill_plan(spark, sf_dir):
    from quire.operators import items

    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_TITLE).alias("t"), F.expr(_FETCHED).alias("n"), F.col("lang").alias("d"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE '' END").alias("nd"))
    now, new = {"title": F.col("t"), "date": F.col("d")}, {"title": F.col("n"), "date": F.col("nd")}
    d = d.withColumn("plan", items.fill_plan(now, new))
    out = items.filled(now, new, F.col("plan"), F.array(F.lit("title")))
    return d.select("doc_id", F.size("plan").alias("n_changes"), F.exists("plan", lambda p: (p["field"] == "title") & p["replaces"]).alias("replaces_title"), *(c.alias(f) for f, c in out.items()))


@query(
    "prj2_prj3_summaries",
    f"""WITH {_D} SELECT p.doc_id AS item_id, 'Doc ' || p.doc_id AS title, lang || '; ' || source AS authors,
    CASE WHEN date <> '' THEN CASE WHEN precision = 'decade' THEN date || 's' WHEN precision = 'month' AND m BETWEEN 1 AND 12 THEN strftime(make_date(2000, m, 1), '%b') || ' ' || split_part(date, '-', 1)
    WHEN precision = 'day' AND m BETWEEN 1 AND 12 AND dd IS NOT NULL THEN strftime(make_date(2000, m, 1), '%b') || ' ' || dd || ', ' || split_part(date, '-', 1) ELSE date END END AS date,
    CASE WHEN p.doc_id % 8 < 1 THEN '—' ELSE repeat('★', least(p.doc_id % 8, 5)::INT) || repeat('☆', (5 - least(p.doc_id % 8, 5))::INT) END AS stars, lang AS tags, CASE WHEN p.doc_id % 3 > 0 THEN (p.doc_id % 3)::VARCHAR ELSE '' END AS sources
    FROM p JOIN documents d ON d.doc_id = p.doc_id""",
)
def summaries(spark, sf_dir):
    from quire.operators import items

    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.to_json(F.array("lang", "source")).alias("authors"), F.expr(DATE).alias("date"), F.expr(PRECISION).alias("precision"),
        F.expr("cast(doc_id % 8 AS int)").alias("quality"), F.array(F.col("lang"), F.lit("MANAGED")).alias("tags"), F.expr("doc_id % 3").alias("n_sources"),
    )
    return items.summaries(d, "Managed")


OTHER_NAME = "CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN concat(p_name, ' ', p_brand) WHEN 2 THEN upper(p_name) WHEN 3 THEN substr(p_name, 1, 4) ELSE p_brand END"


@query(
    "fn12_similarity",
    f"""WITH v AS (SELECT p_partkey, lower(p_name) AS a, lower({OTHER_NAME}) AS b FROM part)
    SELECT p_partkey, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 ELSE round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 9) END AS similarity FROM v""",
)
def similarity(spark, sf_dir):
    from quire.operators.similarity import similarity as score

    return table(spark, sf_dir, "part").select("p_partkey", F.round(score(F.col("p_name"), F.expr(OTHER_NAME)), 9).alias("similarity"))


@query("src15_organization", "SELECT n_nationkey::BIGINT AS folder_id, n_regionkey::BIGINT AS parent_id, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_items FROM nation")
def organization(spark, sf_dir):
    path = shared_folder(spark, "organization")
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    src.write_organization(nation.selectExpr("cast(n_nationkey AS long) AS folder_id", "cast(n_regionkey AS long) AS parent_id", "n_name AS name"), supplier.selectExpr("cast(s_suppkey AS long) AS item_id", "cast(s_nationkey AS long) AS folder_id"), path)
    folders, members = src.read_organization(spark, path)
    counts = members.groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
    return folders.join(counts, "folder_id", "left").select("folder_id", "parent_id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))


@query("src17_organized_output", "SELECT o_orderkey, o_orderpriority AS collection, printf('%05d %s', (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey))::INT, o_orderpriority) AS file_name FROM orders")
def organized(spark, sf_dir):
    from quire.operators.sequence import numbered

    path = shared_folder(spark, "organized")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("collection"))
    src.write_by_collection(numbered(rows, "collection", "o_orderkey"), path)
    return spark.read.parquet(path).select("o_orderkey", F.col("collection").cast("string").alias("collection"), "file_name")


@query("fts5_compacted_index", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(source || ' ' || lang || ' ' || coalesce(text, ''))), '[\\p{L}\\p{N}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY term")
def compacted(spark, sf_dir):
    from quire.operators import textindex

    first, second = shared_folder(spark, "index"), shared_folder(spark, "compacted")
    docs, columns = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), ("source", "lang", "text")
    for segment in range(2):
        textindex.write_segment(docs.where(f"doc_id % 2 = {segment}"), columns, "doc_id", first, segment, keep_tokens=False)
    textindex.compact(spark, first, second)
    return spark.read.parquet(f"{second}/postings").groupBy("term").agg(F.sum("n_docs").alias("n_docs"))


#: A note with all keys of a header, two references and unknown keys, by a document's columns; expressions that Spark and DuckDB read alike.
TYPED_NOTE = """concat('---', chr(10), 'schema: 2', chr(10), 'id: n', cast(doc_id AS string), chr(10), 'kind: note', chr(10), 'title: "A, ', source, ': b"', chr(10), 'authors: [X, "Y, Z"]', chr(10), 'date: 1968-05', chr(10),
'date_precision: month', chr(10), 'date_uncertain: ', CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END, chr(10), CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('quality: ', cast(doc_id % 4 AS string), chr(10)) END, 'own: kept', chr(10), '  - below', chr(10),
'tags:', chr(10), '  - ', lang, chr(10), '  - "q r"', chr(10), 'roundup: ', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'no' END, chr(10), 'zotero:', chr(10), '  - selectLink: "z://', cast(doc_id AS string), '"', chr(10), '    itemKey: K', cast(doc_id % 7 AS string), chr(10),
'    fetchedAt: 2024-01-02T03:04:05Z', chr(10), '    extra: 1', chr(10), '  - itemKey: L', chr(10), 'created: 2020-02-03T04:05:06+01:00', chr(10), 'modified: "never"', chr(10), '---', chr(10), 'body of ', source)"""


@query(
    "src10_typed_header",
    """SELECT doc_id, 2 AS schema, 'n' || doc_id AS id, 'A, ' || source || ': b' AS title, 'X|Y, Z' AS authors, doc_id % 3 = 0 AS date_uncertain, nullif(doc_id % 4, 0)::INT AS quality, lang || '|q r' AS tags, doc_id % 2 = 0 AS roundup, 2::BIGINT AS n_references,
    'z://' || doc_id || '|K' || (doc_id % 7) || '|L' AS item_keys, '2024-01-02 03:04:05' AS fetched_at, 'extra: 1' AS extra, '2020-02-03 03:05:06' AS created, true AS no_modified, 'own: kept' || chr(10) || '  - below' AS own, 'body of ' || source AS body, true AS same_again FROM documents""",
)
def typed_header(spark, sf_dir):
    """All keys of a header, typed, and whether the note written anew reads the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(TYPED_NOTE.replace("chr(", "char(")).alias("note"))
    both = docs.select("doc_id", headers.header("note").alias("h"), headers.header(headers.again("note")).alias("again"))
    first, second, time = F.col("h.zotero")[0], F.col("h.zotero")[1], lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return both.select(
        "doc_id", "h.schema", "h.id", "h.title", F.array_join("h.authors", "|").alias("authors"), "h.date_uncertain", "h.quality", F.array_join("h.tags", "|").alias("tags"), "h.roundup", F.size("h.zotero").cast("long").alias("n_references"),
        F.concat_ws("|", first["select_link"], first["item_key"], second["item_key"]).alias("item_keys"), time(first["fetched_at"]).alias("fetched_at"), F.array_join(first["unknown"], "|").alias("extra"), time(F.col("h.created")).alias("created"),
        F.col("h.modified").isNull().alias("no_modified"), F.array_join("h.unknown", "|").alias("own"), "h.body", (F.to_json("h") == F.to_json("again")).alias("same_again"),
    )


@query("src1_scan_verdicts", """SELECT lang, source, 1::BIGINT AS n_files, true AS has_bytes, 0::BIGINT AS unreadable, 0::BIGINT AS directory_errors, 0::BIGINT AS vanished, true AS is_clean FROM (SELECT DISTINCT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents)""")
def scan_verdicts(spark, sf_dir):
    """Documents written as a tree, a folder for each language and source with one file, and the verdicts of a scan of each."""
    root = shared_folder(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *(F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")))
    docs.repartition("lang", "source").write.partitionBy("lang", "source").parquet(root)
    found = trees.tree(spark, root)
    part = lambda n: F.regexp_extract("path", f"/{n}=([^/]*)/", 1).alias(n)
    kinds = {"unreadable": trees.UNREADABLE, "directory_errors": trees.DIRECTORY_ERROR, "vanished": trees.VANISHED}
    wrong = {n: F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()}
    by_folder = found.groupBy(part("lang"), part("source")).agg(F.count_if(F.col("kind") == trees.FILE).alias("n_files"), F.min(F.col("size") > 0).alias("has_bytes"), *wrong.values())
    return by_folder.withColumn("is_clean", F.col("unreadable") + F.col("directory_errors") == 0)


@query("src1_src2_scan")
def scanned(spark, sf_dir):
    found = src.fingerprints(spark, f"{sf_dir}/*.parquet")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", src.accepted(F.col("path")).alias("accepted"))
