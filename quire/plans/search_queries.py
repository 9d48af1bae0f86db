"""Full-text queries over documents: text as body, source as classification, language and id as name."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import fulltext as ft
from quire.operators import textindex as ix
from quire.operators.ranking import with_place
from quire.operators.sequence import occurrences
from quire.session import shared_folder, table

QUERIES: dict = {}
ORACLES: dict = {}

READER = {"body": 1.0, "classification": 5.0, "name": 10.0}
NOTES = {"body": 1.0, "classification": 6.0, "name": 10.0}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.col("source").alias("classification"), F.concat_ws(" ", "lang", "doc_id").alias("name"))


def _bm25(weights: dict, terms: list[tuple[list[str], bool]], tail: str) -> str:
    """terms: (words, is a prefix)."""
    cols = {"body": "text", "classification": "source", "name": "lang || ' ' || doc_id"}
    toks = " UNION ALL ".join(f"SELECT doc_id, {i} AS c, {float(weights[c])} AS w, regexp_extract_all(strip_accents(lower(coalesce({e}, ''))), '[\\p{{L}}\\p{{N}}]+') AS ts FROM documents" for i, (c, e) in enumerate(cols.items()))
    n, counts = len(terms), []
    for k, (words, prefix) in enumerate(terms):
        places = ["tok", "follows"][: len(words)]
        last = f"starts_with({places[-1]}, '{words[-1]}')" if prefix else f"{places[-1]} = '{words[-1]}'"
        test = " AND ".join([*(f"{p} = '{w}'" for p, w in zip(places[:-1], words[:-1])), last])
        counts.append(f"coalesce(sum(w) FILTER ({test}), 0) AS f{k}")
    idf = lambda k: f"CASE WHEN n > 2 * n{k} THEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END"
    part = " + ".join(f"{idf(k)} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * z / mean))" for k in range(n))
    return f"""WITH l AS ({toks}), t AS (SELECT doc_id, c, w, unnest(ts) AS tok, generate_subscripts(ts, 1) AS j FROM l), u AS (SELECT *, lead(tok) OVER (PARTITION BY doc_id, c ORDER BY j) AS follows FROM t),
    c AS (SELECT doc_id, count(*) AS z, {", ".join(counts)} FROM u GROUP BY doc_id),
    s AS (SELECT (SELECT count(*) FROM documents) AS n, sum(z) / (SELECT count(*) FROM documents) AS mean, {", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(n))} FROM c),
    r AS (SELECT doc_id, -({part}) AS score FROM c, s WHERE {" AND ".join(f"f{k} > 0" for k in range(n))}) {tail}"""


RANKED = "SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM r"


def _ranked(found):
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank")


@query("fts1_reader_search", _bm25(READER, [(["the"], False), (["src3"], False), (["hea"], True)], RANKED))
def reader(spark, sf_dir):
    return _ranked(ft.search(corpus(spark, sf_dir), READER, "the src3 hea", "doc_id", keep=()))


@query("fts1_notes_search", _bm25(NOTES, [(["with"], False), (["en"], False)], RANKED))
def notes(spark, sf_dir):
    return _ranked(ft.search(corpus(spark, sf_dir), NOTES, "with en", "doc_id", keep=()))


@query("fts1_phrase_search", _bm25(READER, [(["of", "the"], False), (["re"], False)], RANKED))
def phrase(spark, sf_dir):
    return _ranked(ft.search(corpus(spark, sf_dir), READER, "of-the re", "doc_id", keep=()))


@query("fts1_accent_search", _bm25(READER, [(["eleou"], True)], RANKED))
def accent(spark, sf_dir):
    return _ranked(ft.search(corpus(spark, sf_dir), READER, "Éléou", "doc_id", keep=()))


@query("top1_search_limit", _bm25(READER, [(["thin"], True)], RANKED + " ORDER BY rank LIMIT 50"))
def top(spark, sf_dir):
    return _ranked(ft.search(corpus(spark, sf_dir), READER, "thin", "doc_id", limit=50, keep=()))


@query("srt3_relevance_order", _bm25(READER, [(["thin"], True)], "SELECT d.doc_id, row_number() OVER (ORDER BY k ASC NULLS LAST, d.doc_id) AS place FROM documents d LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS k FROM r) x ON x.doc_id = d.doc_id"))
def relevance(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    ranks = ft.search(docs, READER, "thin", "doc_id", keep=()).select("doc_id", "rank")
    met = docs.select("doc_id").join(ranks, "doc_id", "left")
    return with_place(met, [F.col("rank").asc_nulls_last(), F.col("doc_id")]).select("doc_id", "place")


#: Indexes by application and data folder: the first query that needs one writes it.
_indexes: dict[tuple[str, str], str] = {}


def _written(spark, sf_dir):
    """The documents' index, written once for an application and a folder."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _indexes:
        path = shared_folder(spark, "index")
        ix.write_segment(corpus(spark, sf_dir), READER, "doc_id", path, 0)
        _indexes[known] = path
    return _indexes[known]


@query(
    "fts4_index_build",
    """WITH l AS (SELECT doc_id, c, regexp_extract_all(strip_accents(lower(coalesce(e, ''))), '[\\p{L}\\p{N}]+') AS ts FROM (SELECT doc_id, unnest([text, source, lang || ' ' || doc_id]) AS e, unnest(range(3)) AS c FROM documents)),
    t AS (SELECT doc_id, c, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS j FROM l) SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places, sum(j)::BIGINT AS places FROM t GROUP BY term""",
)
def build(spark, sf_dir):
    """A new index in every call, and what it holds of each term."""
    path = shared_folder(spark, "index")
    ix.write_segment(corpus(spark, sf_dir), READER, "doc_id", path, 0)
    held = spark.read.parquet(f"{path}/postings").select("term", "n_docs", F.flatten(F.transform("held", lambda h: h["positions"])).alias("p"))
    return held.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum(F.size("p")).alias("n_places"), F.sum(F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x)).alias("places"))


@query("fts1_index_search", _bm25(READER, [(["the"], False), (["src5"], True)], RANKED))
def by_index(spark, sf_dir):
    return _ranked(ix.search_index(spark, _written(spark, sf_dir), READER, "the src5", "doc_id"))


@query("fts1_index_phrase", _bm25(READER, [(["of", "the"], False), (["re"], False)], RANKED))
def phrase_by_index(spark, sf_dir):
    return _ranked(ix.search_index(spark, _written(spark, sf_dir), READER, "of-the re", "doc_id"))


@query("fts1_index_prefix_limit", _bm25(READER, [(["thin"], True)], RANKED + " ORDER BY rank LIMIT 50"))
def prefix_by_index(spark, sf_dir):
    return _ranked(ix.search_index(spark, _written(spark, sf_dir), READER, "thin", "doc_id", limit=50))


@query("top1_index_limit", _bm25(READER, [(["the"], False), (["thin"], True)], RANKED + " ORDER BY rank LIMIT 50"))
def words_by_index(spark, sf_dir):
    """A word and a prefix with a limit: blocks that cannot reach the first fifty are not read."""
    return _ranked(ix.search_index(spark, _written(spark, sf_dir), READER, "the thin", "doc_id", limit=50))


@query("fts4_upserted_limit", _bm25(READER, [(["with"], False), (["en"], False)], RANKED + " ORDER BY rank LIMIT 50").replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 7 <> 2)"))
def upserted_limit(spark, sf_dir):
    """The first fifty of an index of two segments, in which documents of the first are gone."""
    return _ranked(ix.search_index(spark, _two_segments(spark, sf_dir), READER, "with en", "doc_id", limit=50))


@query("fts4_upserted_index", _bm25(READER, [(["with"], False), (["en"], False)], RANKED).replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 7 <> 2)"))
def upserted_index(spark, sf_dir):
    """An index of two thirds of the rows, a third of them with other texts, brought up to date by a segment, then compacted."""
    target = shared_folder(spark, "compacted")
    ix.compact(spark, _two_segments(spark, sf_dir), target)
    return _ranked(ix.search_index(spark, target, READER, "with en", "doc_id"))


def _two_segments(spark, sf_dir):
    now = corpus(spark, sf_dir).where("doc_id % 7 <> 2").selectExpr("*", "cast(doc_id % 50 AS double) AS mtime", "false AS is_dataless")
    before = corpus(spark, sf_dir).where("doc_id % 3 <> 1").selectExpr("*", "cast(CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 50 END AS double) AS mtime")
    path = shared_folder(spark, "index")
    ix.write_segment(before.withColumn("body", F.when(F.col("mtime") < 0, F.lit("with with en stale")).otherwise(F.col("body"))), READER, "doc_id", path, 0)
    ix.apply_changes(ft.changed_rows(before, now, "doc_id", "mtime"), now, READER, "doc_id", path, 1)
    return path


@query("fts2_top2_snippets")
def snippets(spark, sf_dir):
    found = ft.search(corpus(spark, sf_dir), READER, "the hea", "doc_id")
    marked = found.withColumn("snippet", F.when(F.col("rank") <= ft.SNIPPETS, ft.snippet(F.col("body"), ft.parse("the hea"))))
    return marked.select("doc_id", "rank", "snippet", F.size(F.filter(ft.segments(F.col("snippet")), lambda s: s["hit"])).alias("n_hits"))


@query("fn15_snippet_segments", "SELECT doc_id, 'a ' || source || '|b ' || lang || '|end' AS texts, 2::BIGINT AS n_hits FROM documents")
def marked_segments(spark, sf_dir):
    marked = F.concat(F.lit("a "), "source", F.lit(ft.OPEN + "b "), "lang", F.lit(ft.CLOSE + ft.CLOSE + ft.OPEN + "end" + ft.CLOSE))
    d = table(spark, sf_dir, "documents").select("doc_id", ft.segments(marked).alias("s"))
    return d.select("doc_id", F.array_join(F.transform("s", lambda x: x["text"]), "|").alias("texts"), F.size(F.filter("s", lambda x: x["hit"])).cast("long").alias("n_hits"))


@query("fts3_find_counts", "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS n_found FROM documents")
def find_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", occurrences(F.col("text"), "THE").alias("n_found"))


@query(
    "fts4_incremental",
    """WITH o AS (SELECT doc_id, (doc_id % 50)::DOUBLE AS t FROM documents WHERE doc_id % 3 <> 1), n AS (SELECT doc_id, (doc_id % 60)::DOUBLE AS t, doc_id % 17 = 0 AS dl FROM documents WHERE doc_id % 7 <> 2)
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL OR n.dl THEN CASE WHEN o.doc_id IS NOT NULL THEN 'remove' ELSE 'ignore' END WHEN o.doc_id IS NULL THEN 'index' WHEN o.t = n.t THEN 'skip' ELSE 'index' END AS action
    FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
)
def incremental(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 3 <> 1").selectExpr("doc_id", "cast(doc_id % 50 AS double) AS mtime")
    new = docs.where("doc_id % 7 <> 2").selectExpr("doc_id", "cast(doc_id % 60 AS double) AS mtime", "doc_id % 17 = 0 AS is_dataless")
    return ft.changed_rows(old, new, "doc_id", "mtime")
