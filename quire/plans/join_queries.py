"""Queries that join: snapshots, links, hierarchies and similar names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import hierarchy as hi
from quire.operators import merge as mg
from quire.operators import similarity as si
from quire.plans.fixtures import FILES, files
from quire.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("$FILES", FILES)
        return f

    return put


STATUS = "CASE WHEN doc_id % 29 = 0 THEN 'unreadable' WHEN doc_id % 31 = 0 THEN 'no_text_layer' ELSE 'standard' END"


@query("join1_status", f"WITH $FILES SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN {STATUS} END AS status FROM files")
def status(spark, sf_dir):
    indexed = table(spark, sf_dir, "documents").where("doc_id % 4 <> 3").select("doc_id", F.expr(STATUS).alias("status"))
    return files(spark, sf_dir).select("doc_id").join(indexed, "doc_id", "left")


@query("flt6_join2_semi", "WITH $FILES SELECT doc_id FROM files WHERE read_state = 'unread' AND doc_id IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'the '))")
def semi(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("the "))).select("doc_id")
    return files(spark, sf_dir).where("read_state = 'unread'").join(hits, "doc_id", "left_semi").select("doc_id")


@query("join5_remaining", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 3)")
def remaining(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_linenumber >= 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query(
    "join6_incremental_skip",
    """WITH i AS (SELECT 'in/' || p_partkey AS path, 'F' || CASE WHEN p_partkey % 9 = 0 THEN p_partkey // 9 % 50 ELSE p_partkey END AS base, (p_partkey * 7 % 1000)::DOUBLE AS mtime FROM part),
    o AS (SELECT 'F' || p_partkey AS base, CASE WHEN p_partkey % 10 = 0 THEN 'in/' ELSE 'out/' END || p_partkey AS op, (p_partkey * 11 % 1000)::DOUBLE AS om FROM part WHERE p_partkey % 3 <> 0),
    c AS (SELECT *, count(*) OVER (PARTITION BY lower(base)) = 1 AS alone FROM i) SELECT path, c.base, alone AND coalesce(op <> path AND mtime <= om, false) AS skip FROM c LEFT JOIN o ON c.base = o.base""",
)
def skip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    inputs = part.selectExpr("concat('in/', p_partkey) AS path", "concat('F', CASE WHEN p_partkey % 9 = 0 THEN p_partkey div 9 % 50 ELSE p_partkey END) AS base", "cast(p_partkey * 7 % 1000 AS double) AS mtime")
    outputs = part.where("p_partkey % 3 <> 0").selectExpr("concat('F', p_partkey) AS base", "concat(CASE WHEN p_partkey % 10 = 0 THEN 'in/' ELSE 'out/' END, p_partkey) AS output_path", "cast(p_partkey * 11 % 1000 AS double) AS output_mtime")
    return mg.skippable(inputs, outputs)


OLD = "SELECT doc_id, concat('fp', cast(doc_id % 97 AS string)) AS fp, doc_id % 6 <> 0 AS verified FROM documents WHERE doc_id % 5 <> 1"
NEW = "SELECT doc_id, concat('fp', cast(CASE WHEN doc_id % 8 = 0 THEN doc_id % 89 ELSE doc_id % 97 END AS string)) AS fp FROM documents WHERE doc_id % 7 <> 2"


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 5 <> 1").selectExpr("doc_id", "concat('fp', cast(doc_id % 97 AS string)) AS fp", "doc_id % 6 <> 0 AS verified")
    new = docs.where("doc_id % 7 <> 2").selectExpr("doc_id", "concat('fp', cast(CASE WHEN doc_id % 8 = 0 THEN doc_id % 89 ELSE doc_id % 97 END AS string)) AS fp")
    return old, new


def _actions(absent: str) -> str:
    return f"""WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN '{absent}' WHEN o.doc_id IS NULL THEN 'add'
    WHEN o.verified AND o.fp IS NOT DISTINCT FROM n.fp THEN 'reuse' ELSE 'read' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id"""


@query("join7_revalidate", _actions("keep"))
def revalidate(spark, sf_dir):
    return mg.revalidate(*_snapshots(spark, sf_dir), "doc_id", "fp", authoritative=False)


@query("join4_src6_complete_scan", _actions("drop"))
def complete(spark, sf_dir):
    return mg.revalidate(*_snapshots(spark, sf_dir), "doc_id", "fp", authoritative=True)


@query("src6_merge_snapshot", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT doc_id, fp FROM n UNION ALL SELECT doc_id, fp FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def merged(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return mg.merge_snapshot(old.drop("verified"), new, "doc_id", authoritative=False)


@query("src7_upsert", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT doc_id, fp FROM n WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, fp FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n WHERE doc_id % 3 = 0)")
def upserted(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return mg.upsert(old.drop("verified"), new.where("doc_id % 3 = 0"), "doc_id")


@query(
    "src5_snapshot",
    """WITH s AS (SELECT o_custkey AS root_id, o_orderkey AS scan_id, o_orderstatus = 'F' AS complete, o_orderkey % 5 AS n_errors FROM orders),
    l AS (SELECT root_id, arg_max(complete, scan_id) AS c, arg_max(n_errors, scan_id) AS e, max(scan_id) AS m FROM s GROUP BY root_id),
    v AS (SELECT o_custkey AS root_id, bool_and(o_orderkey % 11 <> 0) AS ok FROM orders GROUP BY ALL)
    SELECT l.root_id, CASE WHEN c AND e = 0 AND ok THEN m END AS as_of FROM l JOIN v ON l.root_id = v.root_id""",
)
def snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    newest = orders.groupBy(F.col("o_custkey").alias("root_id")).agg(
        F.max_by(F.struct((F.col("o_orderstatus") == "F").alias("complete"), (F.col("o_orderkey") % 5).alias("n_errors")), "o_orderkey").alias("s"),
        F.max("o_orderkey").alias("m"),
        F.bool_and(F.col("o_orderkey") % 11 != 0).alias("ok"),
    )
    return newest.select("root_id", F.when(F.col("s.complete") & (F.col("s.n_errors") == 0) & F.col("ok"), F.col("m")).alias("as_of"))


@query(
    "join11_overlay",
    """WITH r AS (SELECT p_partkey AS k, p_brand AS value, p_partkey % 5 AS generation FROM part),
    w AS (SELECT l_partkey AS k, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS v, arg_max(l_linestatus = 'F', l_orderkey * 10 + l_linenumber) AS d, arg_max(l_orderkey % 9, l_orderkey * 10 + l_linenumber) AS x FROM lineitem GROUP BY 1)
    SELECT r.k, CASE WHEN coalesce(x > generation, false) THEN v ELSE value END AS value, coalesce(x > generation, false) AS overlaid FROM r LEFT JOIN w ON r.k = w.k WHERE NOT (coalesce(x > generation, false) AND d)""",
)
def overlay(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_brand AS value", "p_partkey % 5 AS generation")
    newest = mg.latest(table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS k", "l_orderkey * 10 + l_linenumber AS at", "l_returnflag AS value", "l_linestatus = 'F' AS dropped", "l_orderkey % 9 AS seq"), ["k"], "at")
    return mg.overlay(rows, newest.drop("at"), "k")


@query(
    "join12_passages",
    """WITH i AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN 'extract' ELSE 'note' END AS kind FROM documents WHERE doc_id % 4 <> 1)
    SELECT conv_id * 1000 + turn AS anchor_id, CASE WHEN turn % 5 = 4 THEN 'malformed' WHEN i.kind IS NULL THEN 'sourceDeleted' WHEN i.kind <> 'note' THEN 'wrongKind' ELSE 'resolved' END AS status
    FROM conversations LEFT JOIN i ON i.item_id = conv_id""",
)
def passages(spark, sf_dir):
    anchors = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS anchor_id", "conv_id AS item_id", "CASE WHEN turn % 5 <> 4 THEN turn END AS block")
    items = table(spark, sf_dir, "documents").where("doc_id % 4 <> 1").selectExpr("doc_id AS item_id", "CASE WHEN doc_id % 3 = 0 THEN 'extract' ELSE 'note' END AS kind")
    return mg.resolve_passages(anchors, items)


@query(
    "join13_link_resolution",
    """WITH $FILES, l AS (SELECT doc_id AS link_id, CASE WHEN doc_id % 4 = 0 THEN '/moved/doc_' || doc_id || '.pdf' WHEN doc_id % 9 = 0 THEN '/root/none.pdf' ELSE path END AS target FROM files),
    b AS (SELECT string_split(path, '/')[-1] AS base, min(path) AS candidate FROM files GROUP BY 1)
    SELECT link_id, CASE WHEN f.path IS NOT NULL THEN 'resolved' WHEN candidate IS NOT NULL THEN 'renamedCandidate' ELSE 'notFound' END AS state, coalesce(f.path, candidate) AS path
    FROM l LEFT JOIN files f ON f.path = l.target LEFT JOIN b ON b.base = string_split(l.target, '/')[-1]""",
)
def links(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", "path")
    asked = f.selectExpr("doc_id AS link_id", "CASE WHEN doc_id % 4 = 0 THEN concat('/moved/doc_', doc_id, '.pdf') WHEN doc_id % 9 = 0 THEN '/root/none.pdf' ELSE path END AS target")
    return mg.resolve_links(asked, f.select("path"))


@query("misc3_missing_results", "SELECT o.o_orderkey AS job_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN 'no_result' ELSE 'image_unreadable' END) AS status FROM orders o")
def missing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return mg.missing_results(orders.selectExpr("o_orderkey AS job_id", "o_orderkey % 2 = 0 AS readable"), orders.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS job_id", "o_orderstatus AS status"))


@query(
    "str4_two_pass_delete",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'pending' END AS state FROM documents WHERE doc_id % 4 = 1",
)
def two_pass(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return mg.confirm_absent(docs, docs.where("doc_id % 4 <> 1"), docs.where("doc_id % 3 = 0"), "doc_id")


# Folders: regions, their nations, and suppliers of which some are their own grandparents' parents; items are parts.
FOLDERS = """SELECT r_regionkey AS folder_id, CASE WHEN r_regionkey = 4 THEN 204 ELSE -1 END AS parent_id FROM region UNION ALL SELECT 100 + n_nationkey, CASE WHEN n_nationkey % 10 = 9 THEN 999 ELSE n_regionkey END FROM nation
UNION ALL SELECT 200 + s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey > 3 THEN 199 + s_suppkey ELSE 100 + s_nationkey END FROM supplier"""
MEMBERS = "SELECT DISTINCT l_partkey AS item_id, 200 + l_suppkey AS folder_id FROM lineitem"
REACH = f"""f AS ({FOLDERS}), c AS (SELECT folder_id AS ancestor, folder_id FROM f UNION SELECT c.ancestor, f.folder_id FROM c JOIN f ON f.parent_id = c.folder_id), m AS ({MEMBERS})"""


def _folders(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    found = region.selectExpr("cast(r_regionkey AS long) AS folder_id", "cast(CASE WHEN r_regionkey = 4 THEN 204 ELSE -1 END AS long) AS parent_id")
    found = found.unionByName(nation.selectExpr("cast(100 + n_nationkey AS long) AS folder_id", "cast(CASE WHEN n_nationkey % 10 = 9 THEN 999 ELSE n_regionkey END AS long) AS parent_id"))
    return found.unionByName(supplier.selectExpr("cast(200 + s_suppkey AS long) AS folder_id", "cast(CASE WHEN s_suppkey % 3 = 0 AND s_suppkey > 3 THEN 199 + s_suppkey ELSE 100 + s_nationkey END AS long) AS parent_id"))


def _members(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey AS long) AS item_id", "cast(200 + l_suppkey AS long) AS folder_id").distinct()


@query("join3_flt2_folder_subtree", f"WITH RECURSIVE {REACH} SELECT DISTINCT p_partkey AS item_id FROM part WHERE p_partkey IN (SELECT item_id FROM m WHERE folder_id IN (SELECT folder_id FROM c WHERE ancestor = 2))")
def subtree(spark, sf_dir):
    items = table(spark, sf_dir, "part").selectExpr("p_partkey AS item_id")
    return hi.items_in_subtree(items, _members(spark, sf_dir), _folders(spark, sf_dir), 2)


@query("agg10_forest_counts", f"WITH RECURSIVE {REACH} SELECT f.folder_id::BIGINT AS folder_id, (SELECT count(DISTINCT item_id) FROM c JOIN m ON m.folder_id = c.folder_id WHERE c.ancestor = f.folder_id) AS n_items FROM f")
def forest(spark, sf_dir):
    return hi.subtree_counts(_folders(spark, sf_dir), _members(spark, sf_dir))


@query(
    "agg12_instances",
    f"WITH m AS ({MEMBERS}), n AS (SELECT item_id, count(*) AS n_folders, min(folder_id) AS only_folder FROM m GROUP BY item_id) SELECT item_id, n_folders, CASE WHEN n_folders = 1 THEN only_folder END::BIGINT AS stranded_by FROM n",
)
def instances(spark, sf_dir):
    counted = _members(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_folders"), F.min("folder_id").alias("only"))
    return counted.select("item_id", "n_folders", F.when(F.col("n_folders") == 1, F.col("only")).alias("stranded_by"))


@query("misc9_members_of", f"WITH m AS ({MEMBERS}) SELECT item_id, folder_id FROM m WHERE folder_id IN (205, 210)")
def members(spark, sf_dir):
    return _members(spark, sf_dir).where(F.col("folder_id").isin(205, 210))


@query("src8_notes_batch", f"WITH o AS ({OLD}), n AS ({NEW}), u AS (SELECT doc_id, fp FROM n WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, fp FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n WHERE doc_id % 3 = 0)) SELECT * FROM u WHERE doc_id % 10 <> 4")
def notes_batch(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return mg.apply_batch(old.drop("verified"), new.where("doc_id % 3 = 0"), table(spark, sf_dir, "documents").where("doc_id % 10 = 4").select("doc_id"), "doc_id")


@query(
    "src8_organization",
    f"""WITH f AS ({FOLDERS}), m AS (SELECT DISTINCT l_partkey AS item_id, 195 + l_suppkey AS folder_id FROM lineitem)
    SELECT 'folder' AS what, folder_id::BIGINT AS folder_id, CASE WHEN parent_id IN (SELECT folder_id FROM f) THEN parent_id END::BIGINT AS other FROM f
    UNION ALL SELECT 'member', folder_id::BIGINT, item_id::BIGINT FROM m WHERE folder_id IN (SELECT folder_id FROM f) AND item_id IN (SELECT p_partkey FROM part WHERE p_size > 5)
    UNION ALL SELECT 'template', folder_id::BIGINT, min(template_id)::BIGINT FROM (SELECT 200 + l_suppkey AS folder_id, l_linenumber AS template_id FROM lineitem WHERE l_quantity > 30) WHERE folder_id IN (SELECT folder_id FROM f) GROUP BY folder_id""",
)
def replaced_organization(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    members = lines.selectExpr("cast(l_partkey AS long) AS item_id", "cast(195 + l_suppkey AS long) AS folder_id")
    assigned = lines.where("l_quantity > 30").selectExpr("cast(200 + l_suppkey AS long) AS folder_id", "cast(l_linenumber AS long) AS template_id")
    kept, inside, templates = mg.replace_organization(_folders(spark, sf_dir), members, assigned, table(spark, sf_dir, "part").where("p_size > 5").selectExpr("p_partkey AS item_id"))
    said = lambda df, what, other: df.select(F.lit(what).alias("what"), "folder_id", F.col(other).alias("other"))
    return said(kept, "folder", "parent_id").unionByName(said(inside, "member", "item_id")).unionByName(said(templates, "template", "template_id"))


ASSIGNED = "SELECT folder_id, folder_id * 10 AS template_id FROM f WHERE folder_id % 4 = 2 OR folder_id < 5"


@query(
    "join14_nearest_template",
    f"""WITH RECURSIVE f AS ({FOLDERS}), up AS (SELECT folder_id, folder_id AS anc, 0 AS depth FROM f UNION SELECT up.folder_id, f.parent_id, depth + 1 FROM up JOIN f ON f.folder_id = up.anc WHERE f.parent_id IN (SELECT folder_id FROM f) AND depth < 12),
    d AS (SELECT folder_id, anc, min(depth) AS depth FROM up GROUP BY ALL), a AS ({ASSIGNED}), x AS (SELECT d.folder_id, depth, template_id, template_id % 3 <> 0 AS live FROM d JOIN a ON a.folder_id = d.anc),
    g AS (SELECT folder_id, arg_min(template_id, depth) FILTER (live) AS t, min(depth) FILTER (live) AS md FROM x GROUP BY folder_id)
    SELECT f.folder_id::BIGINT AS folder_id, g.t::BIGINT AS template_id, (SELECT count(*) FROM x WHERE x.folder_id = f.folder_id AND NOT live AND (g.md IS NULL OR x.depth < g.md)) AS n_dangling FROM f LEFT JOIN g ON g.folder_id = f.folder_id""",
)
def nearest(spark, sf_dir):
    folders = _folders(spark, sf_dir)
    assigned = folders.where("folder_id % 4 = 2 OR folder_id < 5").selectExpr("folder_id", "folder_id * 10 AS template_id")
    return hi.nearest_assignment(folders, assigned, assigned.where("template_id % 3 <> 0").select("template_id"))


@query(
    "misc8_would_cycle",
    f"WITH RECURSIVE {REACH}, v AS (SELECT n_regionkey::BIGINT AS folder_id, (100 + n_nationkey)::BIGINT AS new_parent FROM nation) SELECT v.folder_id, v.new_parent, EXISTS (SELECT 1 FROM c WHERE c.ancestor = v.folder_id AND c.folder_id = v.new_parent) AS cycle FROM v",
)
def cycle(spark, sf_dir):
    moves = table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey AS long) AS folder_id", "cast(100 + n_nationkey AS long) AS new_parent")
    return hi.would_cycle(_folders(spark, sf_dir), moves)


@query("misc8_next_sort_order", "SELECT n_regionkey AS parent_id, (max(n_nationkey) + 1)::BIGINT AS next_order FROM nation GROUP BY 1")
def next_order(spark, sf_dir):
    return hi.next_sort_order(table(spark, sf_dir, "nation").selectExpr("n_regionkey AS parent_id", "n_nationkey AS sort_order"))


# Tags to compare: the names of all parts, in varied spellings.
_TAG = "CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 1 THEN concat(substr(p_name, 1, 2), substr(p_name, 4)) WHEN p_partkey % 5 = 2 THEN concat(p_name, ' ') WHEN p_partkey % 5 = 3 THEN concat(p_name, 'x') ELSE p_name END"


def _tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.expr(_TAG).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


_NORM = "trim(regexp_replace(lower(tag), '\\s+', ' ', 'g'))"
_NORMS = f"t AS (SELECT {_TAG} AS tag, count(*) AS n FROM part GROUP BY 1), w AS (SELECT tag, n, {_NORM} AS norm FROM t), d AS (SELECT DISTINCT norm, length(norm) AS z FROM w)"
_CLOSE = "abs(x.z - y.z) <= 2 AND levenshtein(x.norm, y.norm) <= CASE WHEN greatest(x.z, y.z) >= 9 THEN 2 WHEN greatest(x.z, y.z) >= 5 THEN 1 ELSE 0 END"


@query("join9_similar_pairs", f"WITH {_NORMS} SELECT x.norm AS a, y.norm AS b FROM d x JOIN d y ON x.norm < y.norm AND {_CLOSE}")
def similar(spark, sf_dir):
    return si.similar_pairs(_tags(spark, sf_dir).select(si.normalize(F.col("tag")).alias("norm")).distinct())


@query(
    "agg7_tag_clusters",
    f"""WITH RECURSIVE {_NORMS}, e AS (SELECT x.norm AS a, y.norm AS b FROM d x JOIN d y ON {_CLOSE}), r AS (SELECT norm AS a, norm AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    l AS (SELECT a AS norm, min(b) AS root FROM r GROUP BY a), k AS (SELECT w.*, root FROM w JOIN l ON l.norm = w.norm), h AS (SELECT root, count(*) AS size, sum(n)::BIGINT AS total, arg_min(tag, (-n, tag)) AS canonical FROM k GROUP BY root)
    SELECT tag, n, canonical, total FROM k JOIN h ON h.root = k.root WHERE size > 1""",
)
def clusters(spark, sf_dir):
    return si.clusters(_tags(spark, sf_dir))


# The query set: parts whose key is divisible by 50; all names are folders.
@query(
    "join10_fuzzy_top_k",
    """WITH c AS (SELECT DISTINCT substr(p_name, 1, length(p_name) - 2) || ' ' || p_brand AS candidate FROM part WHERE p_partkey % 50 = 0), f AS (SELECT DISTINCT p_name || ' ' || p_brand AS folder FROM part),
    s AS (SELECT candidate, folder, CASE WHEN lower(candidate) = lower(folder) THEN 1.0 WHEN contains(lower(candidate), lower(folder)) OR contains(lower(folder), lower(candidate)) THEN 0.9
    ELSE 1 - levenshtein(lower(candidate), lower(folder))::DOUBLE / greatest(length(candidate), length(folder)) END AS score FROM c, f)
    SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, folder) AS place FROM s WHERE score >= 0.34 QUALIFY place <= 5""",
)
def fuzzy(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    candidates = part.where("p_partkey % 50 = 0").select(F.concat_ws(" ", F.expr("substr(p_name, 1, length(p_name) - 2)"), "p_brand").alias("candidate")).distinct()
    folders = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("folder")).distinct()
    return si.best_matches(candidates, folders)
