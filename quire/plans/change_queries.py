"""Queries over change feeds and relay objects, with events as the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.merge import latest
from quire.session import shared_folder, table
from quire.streaming import changes, ingest, passes

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


EVENT = {
    "root": "concat('r', cast(user_id % 40 AS string))",
    "kind": "CASE WHEN event_id % 997 = 0 THEN 'root_changed' WHEN event_id % 501 = 0 THEN 'full_rescan' WHEN event_id % 7 = 0 THEN 'subtree' ELSE 'path' END",
    "path": "concat('/a', cast(event_id % 5 AS string), '/b', cast(event_id % 11 AS string), CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('/c', cast(event_id % 13 AS string)) END, CASE WHEN event_id % 19 = 0 THEN '.sb-0a1B2c3D-aZ09xY' ELSE '' END)",
    "own": "event_id % 17 = 0",
}
_EVENTS = "e AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in EVENT.items()) + " FROM events)"


@query(
    "str1_change_feed",
    f"""WITH {_EVENTS}, h AS (SELECT * FROM e WHERE NOT own AND NOT regexp_matches(path, '\\.sb-[0-9A-Fa-f]{{8}}-[A-Za-z0-9]{{6}}$')),
    t AS (SELECT root, max(CASE kind WHEN 'root_changed' THEN 4 WHEN 'full_rescan' THEN 3 WHEN 'subtree' THEN 2 ELSE 1 END) AS top FROM h GROUP BY root),
    r AS (SELECT DISTINCT h.root, kind, path FROM h JOIN t ON h.root = t.root WHERE top < 3), s AS (SELECT root, path FROM r WHERE kind = 'subtree')
    SELECT root, CASE WHEN top = 4 THEN 'root_changed' ELSE 'full_rescan' END AS kind, NULL::VARCHAR AS path FROM t WHERE top >= 3 UNION ALL
    SELECT root, kind, path FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.root = r.root AND (starts_with(r.path, s.path || '/') OR (r.kind = 'path' AND r.path = s.path)))""",
)
def change_feed(spark, sf_dir):
    return changes.reduce_changes(table(spark, sf_dir, "events").select(*(F.expr(v).alias(k) for k, v in EVENT.items())))


@query(
    "str2_apply_changes",
    """WITH t AS (SELECT '/s' || (doc_id % 10) || '/d' || doc_id AS path, doc_id AS value FROM documents WHERE doc_id % 9 <> 0),
    f AS (SELECT '/s' || (doc_id % 10) || '/d' || doc_id AS path, doc_id + 1000000 AS value, CASE WHEN doc_id % 5 = 0 THEN 'unreadable' WHEN doc_id % 7 = 0 THEN 'vanished' ELSE 'read' END AS status FROM documents WHERE doc_id % 3 = 0)
    SELECT coalesce(t.path, f.path) AS path, CASE WHEN status = 'read' THEN f.value ELSE t.value END AS value FROM t FULL JOIN f ON t.path = f.path
    WHERE coalesce(status, '') <> 'vanished' AND NOT (status IS NULL AND (starts_with(t.path, '/s1/') OR starts_with(t.path, '/s2/'))) AND NOT (coalesce(status, '') = 'unreadable' AND t.path IS NULL)""",
)
def applied(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.expr("concat('/s', doc_id % 10, '/d', doc_id)").alias("path")
    current = docs.where("doc_id % 9 <> 0").select(path, F.col("doc_id").alias("value"))
    fresh = docs.where("doc_id % 3 = 0").select(path, (F.col("doc_id") + 1_000_000).alias("value"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'unreadable' WHEN doc_id % 7 = 0 THEN 'vanished' ELSE 'read' END").alias("status"))
    changed = spark.range(1, 4).select(F.concat(F.lit("/s"), "id").alias("path"), (F.col("id") < 3).alias("clean"))
    return changes.apply_changes(current, fresh, changed)


SIDECAR = {
    "key": "concat('g', user_id, '__', cast(event_id % 40 AS string))",
    "group": "concat('g', user_id, CASE WHEN user_id % 31 = 0 THEN '..' ELSE '' END)",
    "fp": "concat(event_type, cast(month(ts) AS string))",
    "epoch": "CASE WHEN event_id % 23 = 0 THEN 'old' ELSE 'now' END",
    "token": "'t'",
    "replaces": "CASE WHEN event_id % 29 = 0 THEN concat('g', user_id, '__', cast((event_id + 1) % 40 AS string)) END",
    "media": "event_id % 13 <> 0",
    "n": "event_id",
}
_SIDECARS = "c AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in SIDECAR.items()) + " FROM events)"
STATE = "SELECT concat('g', user_id, '__', cast(event_id % 40 AS string)) AS key, concat(event_type, cast(month(ts) AS string)) AS fp, event_id % 37 = 0 AS dead, event_id AS batch FROM events WHERE event_id % 2 = 0"


@query(
    "str3_idempotent_ingest",
    f"""WITH {_SIDECARS}, l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1), s AS (SELECT * FROM ({STATE}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY batch DESC) = 1),
    r AS (SELECT DISTINCT replaces AS key FROM l WHERE epoch = 'now' AND NOT contains("group", '..') AND replaces IS NOT NULL)
    SELECT l.key, l.fp, CASE WHEN contains("group", '..') THEN 'quarantine' WHEN epoch <> 'now' THEN 'foreign' WHEN r.key IS NOT NULL OR coalesce(s.dead, false) THEN 'dead' WHEN NOT media THEN 'wait' WHEN s.fp = l.fp THEN 'skip' ELSE 'ingest' END AS action
    FROM l LEFT JOIN s ON s.key = l.key LEFT JOIN r ON r.key = l.key""",
)
def idempotent(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    state = events.where("event_id % 2 = 0").selectExpr("concat('g', user_id, '__', cast(event_id % 40 AS string)) AS key", "concat(event_type, cast(month(ts) AS string)) AS fp", "event_id % 37 = 0 AS dead", "event_id AS batch")
    return ingest.decide(events.select(*(F.expr(v).alias(k) for k, v in SIDECAR.items())), state, "now", "t")


@query(
    "str5_ready_controls",
    """WITH p AS (SELECT DISTINCT user_id, event_id % 8 AS seq FROM events WHERE event_id % 6 <> 0), g AS (SELECT DISTINCT user_id FROM events)
    SELECT 'g' || g.user_id AS "group", count(*) FILTER (p.seq IS NULL) = 0 AS ready, count(*) FILTER (p.seq IS NULL) AS n_missing FROM g, (SELECT unnest([0, 1, 2, 3]) AS seq) x LEFT JOIN p ON p.user_id = g.user_id AND p.seq = x.seq GROUP BY 1""",
)
def controls(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    group = F.concat(F.lit("g"), "user_id").alias("group")
    processed = events.where("event_id % 6 <> 0").select(group, (F.col("event_id") % 8).cast("int").alias("seq"))
    asked = events.select(group).distinct().withColumn("seqs", F.array(*map(F.lit, range(4))))
    return ingest.ready_controls(asked, processed)


@query(
    "str6_orphans",
    """WITH o AS (SELECT 's' || (event_id % 3000) AS stem, CASE event_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'media' ELSE 'receipt' END AS kind, ts AS modified FROM events), m AS (SELECT max(ts) AS top FROM events),
    k AS (SELECT stem, bool_or(kind = 'photo') AS hp, bool_or(kind = 'media') AS hm FROM o GROUP BY stem),
    x AS (SELECT o.stem, kind, CASE WHEN kind = 'media' AND NOT hp THEN 'no_sidecar' WHEN kind = 'photo' AND NOT hm THEN 'no_media' WHEN kind = 'receipt' AND NOT hp AND NOT hm THEN 'drained' END AS reason FROM o JOIN k ON k.stem = o.stem WHERE modified < TIMESTAMP '2030-01-01 00:00:00' - INTERVAL 10 MINUTE)
    SELECT * FROM x WHERE reason IS NOT NULL""",
)
def orphans(spark, sf_dir):
    objects = table(spark, sf_dir, "events").selectExpr("concat('s', event_id % 3000) AS stem", "CASE event_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'media' ELSE 'receipt' END AS kind", "ts AS modified")
    return ingest.orphans(objects, "2030-01-01 00:00:00")


@query("str8_replace_on_resend", "SELECT user_id, event_id % 20 AS seq, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL")
def resend(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 20).alias("seq"), "event_id", "event_type")
    return latest(rows, ["user_id", "seq"], "event_id")


@query(
    "str7_late_boxes",
    """WITH p AS (SELECT 'g' || user_id AS "group", event_id AS seq, CASE WHEN event_id % 11 = 0 THEN event_type END AS box, 'k' || (event_id % 3) AS current FROM events)
    SELECT "group", seq, CASE WHEN box IS NOT NULL THEN current ELSE coalesce(last_value(box IGNORE NULLS) OVER (PARTITION BY "group" ORDER BY seq), current) END AS assigned FROM p""",
)
def late_boxes(spark, sf_dir):
    """Pages in two batches, the boxes of which come last; the newest result of each page counts."""
    pages = table(spark, sf_dir, "events").selectExpr("concat('g', user_id) AS `group`", "event_id AS seq", "CASE WHEN event_id % 11 = 0 THEN event_type END AS box", "concat('k', event_id % 3) AS current")
    results = _fed(spark, "boxes", (pages.where("box IS NULL"), pages.where("box IS NOT NULL")), passes.pin_boxes)
    return latest(results, ["group", "seq"], "batch").drop("batch")


def _fed(spark, name, parts, start):
    """What a stream gives in all its batches, each of which is one of the parts, sent after the one before was done."""
    place = shared_folder(spark, name)
    for number, part in enumerate(parts):
        part.write.parquet(f"{place}/feed/{number}")
        stream = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{place}/feed")
        start(stream, f"{place}/state", f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out/batch=*").withColumn("batch", F.col("batch").cast("long"))


@query(
    "str4_stream_deletes",
    """SELECT doc_id, 1::BIGINT AS batch FROM documents WHERE doc_id % 12 = 1 UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 3 = 1 AND doc_id % 12 <> 1""",
)
def stream_deletes(spark, sf_dir):
    """Three listings of the documents as a stream: the first lacks every fourth, the others every third."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    listings = (docs.where("doc_id % 4 <> 1"), docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 <> 1"))
    return _fed(spark, "deletes", listings, lambda stream, *places: passes.confirm_deletes(stream, docs, "doc_id", *places))


@query(
    "str5_stream_controls",
    """WITH p AS (SELECT 'g' || user_id AS "group", event_id % 8 AS seq, min((event_id // 8) % 2) AS b FROM events WHERE event_id % 6 <> 0 AND event_id % 8 < 4 GROUP BY ALL)
    SELECT "group", max(b)::BIGINT AS batch FROM p GROUP BY "group" HAVING count(*) = 4""",
)
def stream_controls(spark, sf_dir):
    """Controls come with the first of two batches of pages, and each out with the batch that completes its pages."""
    events = table(spark, sf_dir, "events")
    group = F.concat(F.lit("g"), "user_id").alias("group")
    page = lambda b: events.where(f"event_id % 6 <> 0 AND (event_id div 8) % 2 = {b}").select(group, (F.col("event_id") % 8).cast("int").alias("seq"), F.lit(None).cast("array<int>").alias("seqs"))
    asked = events.select(group).distinct().select("group", F.lit(None).cast("int").alias("seq"), F.array(*map(F.lit, range(4))).alias("seqs"))
    return _fed(spark, "controls", (page(0).unionByName(asked), page(1)), passes.release_controls)


@query(
    "str6_stream_orphans",
    """WITH o AS (SELECT DISTINCT 's' || (event_id // 2) AS stem, CASE event_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'media' ELSE 'receipt' END AS kind, CASE WHEN event_id % 5 < 3 THEN 0 ELSE 1 END AS b FROM events),
    k AS (SELECT t AS batch, stem, kind, bool_or(kind = 'photo') OVER w AS hp, bool_or(kind = 'media') OVER w AS hm FROM (SELECT DISTINCT t, stem, kind FROM o, (VALUES (0), (1)) v(t) WHERE b <= t) WINDOW w AS (PARTITION BY t, stem)),
    x AS (SELECT batch::BIGINT AS batch, stem, kind, CASE WHEN kind = 'media' AND NOT hp THEN 'no_sidecar' WHEN kind = 'photo' AND NOT hm THEN 'no_media' WHEN kind = 'receipt' AND NOT hp AND NOT hm THEN 'drained' END AS reason FROM k)
    SELECT * FROM x WHERE reason IS NOT NULL AND (batch = 0 OR (stem, kind) NOT IN (SELECT (stem, kind) FROM x WHERE batch = 0 AND reason IS NOT NULL))""",
)
def stream_orphans(spark, sf_dir):
    """Objects in two batches; what misses its partner comes out once, in the batch that finds it."""
    events = table(spark, sf_dir, "events")
    part = lambda b: events.where(f"event_id % 5 {'<' if b == 0 else '>='} 3").selectExpr("concat('s', event_id div 2) AS stem", "CASE event_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'media' ELSE 'receipt' END AS kind", "ts AS modified")
    now = F.to_timestamp(F.lit("2030-01-01 00:00:00"))
    return _fed(spark, "orphans", (part(0), part(1)), lambda stream, *places: passes.sweep_orphans(stream, now, *places))
