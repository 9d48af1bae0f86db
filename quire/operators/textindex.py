"""A written full-text index: the answers of fulltext.search() from tables whose reading follows the terms of a query.

An index is a folder of segments. Each has these tables:

* rows: the segment's documents by number, with key, number of tokens, and unless told otherwise their tokens by column,
  for users of a table of them: neither searches nor compact() read these.
* postings: for each term and BLOCK document numbers one row, with its entries (document, column, positions), and what a
  search can tell without them (columns by their places among those of most): how many documents it has, how many tokens, the most occurrences of the term in one by
  column, the least number of tokens. A term with over PART_TOKENS tokens in a block has some rows for it.
* files: least and greatest term of each file of postings.
* gone: by block, numbers of earlier segments' documents that this one replaced or removed.
* stats: one row with the documents and tokens that came, and those that went.

A search takes the figures of the collection from stats, chooses files by their terms, reads the blocks of its terms and
leaves out what is gone. With a limit and no phrase, it scores the blocks with the greatest possible scores first; blocks
that cannot reach the last of these scores are not read. Keys are looked up for the documents found.
Changes go into a segment of their own, and compact() makes one segment of many by merging their postings.

Entries are gathered where documents or postings are read, some millions of tokens at a time, and move packed
(operators/postings.py), once, to the file that a sample of tokens says: files are ranges of terms with near the same
number of tokens, and a term that fills more than one is dealt to them by blocks. Texts are written as their tokens for the time
of that, and the files of a move go with the write that reads them, so that a disk holds little besides the index.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.operators import postings as held_postings
from quire.operators.fulltext import B, K1, Term, inverse_frequency, parse, ranked, score_of, token_text, tokens
from quire.session import cut, drop_folder, shuffles_dropped

#: Documents in a block, as a power of two.
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: Rows of a page of a rows file, and bytes of a row group of postings: how finely they can be read.
PAGE_ROWS, GROUP_BYTES = 128, 8 << 20
#: Rows of a page of a postings file.
POSTINGS_PAGE_ROWS = 1024
#: Of all files of an index.
CODEC = "zstd"
#: Tokens of a file of postings, which is made by one task, and of a part of a block.
FILE_TOKENS, PART_TOKENS = 1_000_000, 1_000_000
#: Tokens by which terms are dealt: for each file, and at most in all.
SAMPLED_PER_FILE, SAMPLED = 256, 1 << 18
#: Blocks or documents that are listed in a filter, which reaches the files; more are joined.
LISTED = 4096
#: So many documents found, of some 30 bytes, meet the rows by broadcast.
MOST_BROADCAST = 500_000
#: So many documents that are gone, of four bytes, meet the rows by broadcast.
MOST_GONE = 4_000_000
#: So many documents of blocks in which some are gone, of two bytes, meet the rows and postings by broadcast.
MOST_MOVED = 16_000_000
#: Blocks scored first in a search with a limit, for each document wanted.
FIRST_BLOCKS = 2
TABLES = ("rows", "postings", "files", "gone", "stats")
ENTRY = "struct<term:string,c:string,positions:array<int>>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def entries_of(text: Column, column: str) -> Column:
    """The distinct terms of a text with their positions, in order: its tokens are sorted with their places, and each run is one entry."""

    def runs(sorted_tokens: Column) -> Column:
        n = F.size(sorted_tokens)
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(sorted_tokens, i)["term"] != F.get(sorted_tokens, i - 1)["term"])))

        def entry(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(sorted_tokens, at)["term"].alias("term"),
                    F.lit(column).alias("c"),
                    F.transform(F.slice(sorted_tokens, at + 1, F.coalesce(F.get(starts, k + 1), n) - at), lambda x: x["at"]).alias("positions"),
                ),
            )

        return _let(first, entry)

    return _let(F.sort_array(F.transform(tokens(text), lambda t, i: F.struct(t.alias("term"), i.alias("at")))), runs)


def _segment(path: str, table: str, segment: int) -> str:
    return f"{path}/{table}/segment={segment}"


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}/segment=*")


def write_segment(docs: DataFrame, columns, key: str, path: str, segment: int, removed: DataFrame | None = None, files: int | None = None, keep_tokens: bool = True) -> None:
    """Rows that are new or other, and keys that are gone, as one segment of an index; the newest one may be written again.

    Keys of docs must differ from each other and from those of removed. Null texts have no tokens; other columns are not
    read; docs may be empty. Texts are read once and stay where they are; what moves is packed postings. Without
    keep_tokens, which should be alike in all segments, the rows have no tokens.
    """
    columns, spark = list(columns), docs.sparkSession
    names = [f"t{k}" for k in range(len(columns))]
    given = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(key).alias("key"), *(token_text(F.col(c)).alias(n) for c, n in zip(columns, names)))
    schema = StructType([StructField("doc", LongType()), given.schema["key"], StructField("n_tokens", LongType()), *(StructField(n, StringType()) for n in names)])
    texts_path, rows_path = f"{path}/texts-{segment}", _segment(path, "rows", segment)
    _write(given.mapInArrow(held_postings.spaced(len(columns)), schema), texts_path, PAGE_ROWS)
    texts = spark.read.schema(schema).parquet(texts_path)
    listed = F.struct(*(F.when(F.col(n) == "", F.array().cast("array<string>")).otherwise(F.split(n, " ")).alias(c) for c, n in zip(columns, names)))
    _write(texts.select("doc", "key", "n_tokens", *([listed.alias("tokens")] if keep_tokens else [])), rows_path, PAGE_ROWS)
    rows = spark.read.parquet(rows_path)

    total = _counted(rows).first()
    files = files or max(1, -(-total["n_tokens"] // FILE_TOKENS))
    places = _places(texts, names, total["n_docs"], total["n_tokens"], files) if files > 1 else None
    _write_postings(texts.drop("key"), held_postings.from_tokens(len(columns), BLOCK_BITS, PART_TOKENS, places, files), columns, path, segment, files)
    drop_folder(spark, texts_path)
    _write_figures(rows, path, segment, removed.select(F.col(key).alias("key")) if removed is not None else None)


def _write(df: DataFrame, path: str, page_rows: int, group_bytes: int | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", CODEC).option("parquet.page.row.count.limit", page_rows)
    (writer.option("parquet.block.size", group_bytes) if group_bytes else writer).parquet(path)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def _sampled_in(n_tokens: int, files: int) -> int:
    """One in so many tokens is sampled."""
    return max(1, n_tokens // min(SAMPLED, SAMPLED_PER_FILE * files))


def _places(texts: DataFrame, names: list[str], n_docs: int, n_tokens: int, files: int) -> held_postings.Places:
    """Sampled terms in order, and where each begins and the last ends among all tokens, on a scale of 0 to files.

    The sample says only which file has which terms; at most about SAMPLED tokens reach the driver.
    """
    one_in = _sampled_in(n_tokens, files)
    of_docs = max(1, min(one_in, n_docs // 64))
    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(of_docs)) == 0)
    each = some.select("doc", F.posexplode(F.split(F.concat_ws(" ", *names), " ")).alias("at", "term")).where("term <> ''")
    return _scaled(each.where(F.pmod(F.xxhash64("at", "doc"), F.lit(max(1, one_in // of_docs))) == 0).groupBy("term").count(), files)


def _places_of_postings(postings: DataFrame, n_tokens: int, files: int) -> held_postings.Places:
    """As _places(): rows of as many tokens as one is sampled of are all taken, and others as often as they have tokens."""
    one_in, n = _sampled_in(n_tokens, files), F.col("n_tokens")
    some = postings.where((n >= one_in) | (F.pmod(F.xxhash64("term", "segment", "block"), F.lit(one_in)) < n))
    return _scaled(some.groupBy("term").agg(F.sum(F.greatest(n, F.lit(one_in))).alias("count")), files)


def _scaled(sampled: DataFrame, files: int) -> held_postings.Places:
    few = sampled.toPandas()
    order = sorted(zip(few["term"], few["count"]))
    share = np.cumsum([0, *(n for _, n in order)]).astype(np.float64)
    return np.array([t for t, _ in order], object), share * files / max(share[-1], 1.0)


def _write_postings(given: DataFrame, pieces: Callable, columns: list[str], path: str, segment: int, files: int) -> None:
    """Postings and files, from what pieces() makes of the rows given. What moves there is off the disks when they are written."""
    postings_path = _segment(path, "postings", segment)
    dealt = given.mapInArrow(pieces, "file int, piece binary").repartitionById(files, F.col("file"))
    with shuffles_dropped(given.sparkSession):
        _write(dealt.mapInArrow(held_postings.laid_out(columns, BLOCK_BITS, PART_TOKENS), held_postings.schema(columns)), postings_path, POSTINGS_PAGE_ROWS, GROUP_BYTES)
    _term_ranges(given.sparkSession.read.parquet(postings_path)).repartition(1).write.mode("overwrite").parquet(_segment(path, "files", segment))


def _write_figures(rows: DataFrame, path: str, segment: int, removed: DataFrame | None) -> None:
    """What is gone, and the figures of the segment."""
    spark = rows.sparkSession
    gone = _gone(rows, path, segment, removed).select("of_segment", F.shiftright("doc", BLOCK_BITS).alias("block"), (F.col("doc") % BLOCK).cast("int").alias("at"), "n_tokens")
    by_block = gone.groupBy("of_segment", "block").agg(F.sort_array(F.collect_list("at")).alias("gone_at"), F.sum("n_tokens").alias("n_tokens"))
    by_block.write.mode("overwrite").parquet(_segment(path, "gone", segment))
    went = spark.read.parquet(_segment(path, "gone", segment)).agg(F.coalesce(F.sum(F.size("gone_at")), F.lit(0)).cast("long").alias("n_gone"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens_gone"))
    _counted(rows).crossJoin(went).write.mode("overwrite").parquet(_segment(path, "stats", segment))  # a row each


def _term_ranges(postings: DataFrame) -> DataFrame:
    """file, first_term and last_term of files of postings, which are in order: the terms of their first and last rows.

    A least and greatest text is not asked for, as Spark would sort all rows that a task reads for it.
    """
    every = postings.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), "term")
    last = every.groupBy("file").agg(F.max("at").alias("last"))  # a row for each file
    ends = cut(every.join(F.broadcast(last), "file").where("at = 0 OR at = last"))
    return ends.where("at = 0").select("file", F.col("term").alias("first_term")).join(F.broadcast(ends.where("at = last").select("file", F.col("term").alias("last_term"))), "file")


def _gone(rows: DataFrame, path: str, segment: int, removed: DataFrame | None) -> DataFrame:
    """of_segment, doc and n_tokens of live documents of earlier segments whose keys this one has or removes."""
    spark = rows.sparkSession
    if segment == 0:
        return rows.limit(0).select(F.lit(0).alias("of_segment"), "doc", "n_tokens")
    earlier = _read(spark, path, "rows").where(F.col("segment") < segment).select("segment", "doc", "key", "n_tokens")
    keys = rows.select("key") if removed is None else rows.select("key").unionByName(removed)
    before = _gone_documents(_read(spark, path, "gone").where(F.col("segment") < segment))
    return earlier.join(keys, "key", "left_semi").join(before, ["segment", "doc"], "left_anti").select(F.col("segment").alias("of_segment"), "doc", "n_tokens")


def _gone_documents(gone: DataFrame) -> DataFrame:
    each = gone.select(F.col("of_segment").alias("segment"), "block", F.explode("gone_at").alias("at"))
    return each.select("segment", (F.shiftleft("block", BLOCK_BITS) + F.col("at")).alias("doc"))


def apply_changes(actions: DataFrame, current: DataFrame, columns, key: str, path: str, segment: int) -> None:
    """What fulltext.changed_rows() says, as a segment: rows to index, and keys to remove."""
    actions = cut(actions)
    write_segment(current.join(actions.where("action = 'index'"), key, "left_semi"), columns, key, path, segment, actions.where("action = 'remove'"))


def _fits(word: str, prefix: bool) -> Column:
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def _any(tests: list[Column]) -> Column:
    return functools.reduce(Column.__or__, tests)


def words_of(terms: list[Term]) -> dict[tuple[int, int], tuple[str, bool]]:
    """(term, place in it) to (word, is a prefix)."""
    return {(k, j): (w, t.prefix and j + 1 == len(t.words)) for k, t in enumerate(terms) for j, w in enumerate(t.words)}


class Index:
    """An index as a search sees it: its figures, and its tables as DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        total = _read(spark, path, "stats").agg(*(F.sum(n).alias(n) for n in ("n_docs", "n_tokens", "n_gone", "tokens_gone"))).first()  # a row for each segment
        self.n = total["n_docs"] - total["n_gone"]
        self.mean = (total["n_tokens"] - total["tokens_gone"]) / self.n if self.n else None
        self.tokens, self.n_gone = total["n_tokens"] - total["tokens_gone"], total["n_gone"]
        self.any_gone = self.n_gone > 0

    @property
    def rows(self) -> DataFrame:
        """All rows of all segments, also those that are gone."""
        return _read(self.spark, self.path, "rows")

    def gone(self) -> DataFrame:
        """segment, block, gone_at: what is gone of each block."""
        return _read(self.spark, self.path, "gone").groupBy(F.col("of_segment").alias("segment"), "block").agg(F.flatten(F.collect_list("gone_at")).alias("gone_at"))

    def moved(self) -> DataFrame:
        """segment, block, offset and rank: live documents are numbered on end, block by block, those of this one from offset on.

        rank says which of them a document is by its place in the block, 1 being the first and 0 none; it is null where
        nothing is gone and a document is in its old place.
        """
        met = self.rows.groupBy("segment", F.shiftright("doc", BLOCK_BITS).alias("block")).agg(F.count(F.lit(1)).alias("n"))  # a row for each block
        met = self.without_gone(met).withColumn("n", F.col("n") - F.when(F.col("gone_at").isNull(), 0).otherwise(F.size("gone_at")))
        live = F.array_except(F.sequence(F.lit(0), F.lit(BLOCK - 1)), F.col("gone_at"))
        rank = _let(live, lambda x: F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda at: F.array_position(x, at).cast("smallint")))
        before = Window.orderBy("segment", "block").rowsBetween(Window.unboundedPreceding, -1)
        return met.select("segment", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset"), F.when(F.col("gone_at").isNotNull(), rank).alias("rank"))

    def blocks(self, words) -> DataFrame:
        """Blocks of these (word, is a prefix), read from the files that can have them; their number follows the words."""
        may = [(F.col("first_term") < w + "\U0010ffff") & (F.col("last_term") >= w) if prefix else (F.col("first_term") <= w) & (F.col("last_term") >= w) for w, prefix in words]
        found = _read(self.spark, self.path, "files").where(_any(may)).select("segment", "file").collect()
        reader = self.spark.read.option("basePath", f"{self.path}/postings")
        if not found:
            return reader.parquet(f"{self.path}/postings/segment=*").limit(0)
        held = reader.parquet(*(f"{_segment(self.path, 'postings', r['segment'])}/{r['file']}" for r in found))
        return held.where(_any([_fits(w, prefix) for w, prefix in words]))

    def without_gone(self, blocks: DataFrame) -> DataFrame:
        """The blocks with gone_at, null where nothing is gone."""
        return blocks.join(self.gone(), ["segment", "block"], "left") if self.any_gone else blocks.withColumn("gone_at", F.lit(None).cast("array<int>"))


def search_index(spark: SparkSession, path: str, weights: dict[str, float], query: str, key: str, limit: int | None = None) -> DataFrame:
    """key, score and rank as by fulltext.search(), from a written index."""
    index, terms = Index(spark, path), parse(query)
    if not terms or not index.n:
        return index.rows.limit(0).select(F.col("key").alias(key), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    blocks = index.blocks(set(words_of(terms).values()))
    if limit is not None and all(len(t.words) == 1 for t in terms):
        best = _best(index, blocks, terms, weights, limit)
    else:
        met = cut(_counts(index, blocks, terms, weights))
        held = met.agg(*(F.count_if(F.col(f"f{k}") > 0) for k in range(len(terms)))).first()
        best = _scored(met, [inverse_frequency(index.n, h) for h in held], index.mean)
    return ranked(_with_keys(index, best, limit).withColumnRenamed("key", key), key, limit)


def _scored(met: DataFrame, idf: list[float], mean: float) -> DataFrame:
    score, every = score_of([F.col(f"f{k}") for k in range(len(idf))], idf, mean, F.col("z"))
    return met.where(every).select("segment", "doc", score.alias("score"))


def _with_keys(index: Index, found: DataFrame, limit: int | None) -> DataFrame:
    """key and score. With a limit no more documents are looked up than can be among the first; ties with the last one stay.

    Rows are filtered by a list of few documents, or meet a broadcast of a counted number; only more are joined by shuffle.
    """
    found = cut(found)
    if limit is not None:
        last = found.orderBy("score").limit(limit).agg(F.max("score").alias("s")).first()["s"]
        found = found.where(F.col("score") <= F.lit(last)) if last is not None else found.limit(0)
    rows, n = index.rows.select("segment", "doc", "key"), found.count()
    if n <= LISTED:
        rows = rows.where(_listed(found.select("segment", "doc").collect(), "doc"))
    return (F.broadcast(found) if n <= MOST_BROADCAST else found).join(rows, ["segment", "doc"]).select("key", "score")


def _listed(few: list, column: str) -> Column:
    """A filter on segment and another column that reaches the files."""
    by_segment: dict[int, list[int]] = {}
    for r in few:
        by_segment.setdefault(r["segment"], []).append(r[column])
    return _any([(F.col("segment") == s) & F.col(column).isin(v) for s, v in by_segment.items()]) if by_segment else F.lit(False)


def _by_place(blocks: DataFrame, weights: dict[str, float]) -> dict[int, float]:
    """Weights by the places of columns, which entries have."""
    return {k: weights[c] for k, c in enumerate(blocks.schema["most"].dataType.names) if c in weights}


def _counts(index: Index, blocks: DataFrame, terms: list[Term], weights: dict[str, float]) -> DataFrame:
    """segment, doc, z (tokens) and the weighted count f of each term, for live documents with any of the words."""
    by_place = _by_place(blocks, weights)
    live = index.without_gone(blocks.select("segment", "term", "block", "held"))
    each = live.select("segment", "term", "block", "gone_at", F.explode("held").alias("h")).where(F.col("h.c").isin(*by_place) & (F.col("gone_at").isNull() | ~F.array_contains("gone_at", F.col("h.at"))))
    own = each.select("segment", (F.shiftleft("block", BLOCK_BITS) + F.col("h.at")).alias("doc"), "term", "h.c", "h.z", "h.positions")
    weight = F.coalesce(*(F.when(F.col("c") == c, F.lit(float(w))) for c, w in by_place.items()))
    if all(len(t.words) == 1 for t in terms):
        counts = [F.coalesce(F.sum(F.when(_fits(t.words[0], t.prefix), weight * F.size("positions"))), F.lit(0.0)).alias(f"f{k}") for k, t in enumerate(terms)]
        return own.groupBy("segment", "doc").agg(F.first("z").alias("z"), *counts)
    words = words_of(terms)
    places = own.groupBy("segment", "doc", "c").agg(F.first("z").alias("z"), *(F.flatten(F.collect_list(F.when(_fits(*w), F.col("positions")))).alias(f"p{k}_{j}") for (k, j), w in words.items()))

    def times(k: int) -> Column:
        back = lambda j: F.transform(f"p{k}_{j}", lambda x: x - j)
        starts = [back(j) for j in range(len(terms[k].words))]
        return F.size(functools.reduce(F.array_intersect, starts) if len(starts) > 1 else F.col(f"p{k}_0"))

    return places.groupBy("segment", "doc").agg(F.first("z").alias("z"), *(F.sum(weight * times(k)).alias(f"f{k}") for k in range(len(terms))))


def _best(index: Index, blocks: DataFrame, terms: list[Term], weights: dict[str, float], limit: int) -> DataFrame:
    """segment, doc and score of at least the best limit documents that have all words, from blocks that may hold them.

    How many documents have a word is in its blocks, unless some of these are gone, only some columns are searched or a
    prefix stands for several terms; then their numbers are counted, still without their positions.
    """
    narrow = set(weights) != set(blocks.schema["most"].dataType.names)
    exact = index.any_gone or narrow or any(t.prefix for t in terms)
    most = sum((F.lit(float(w)) * F.col(f"most.{c}") for c, w in weights.items()), F.lit(0.0))
    headers = index.without_gone(blocks.select("segment", "term", "block", "n_docs", most.alias("most"), "least", *(["held.at", "held.c"] if exact else [])))
    if exact:
        searched = F.transform(F.filter(F.arrays_zip("at", "c"), lambda h: h["c"].isin(*_by_place(blocks, weights))), lambda h: h["at"])
        headers = headers.withColumn("at", F.array_except(searched, F.coalesce("gone_at", F.array().cast("array<int>"))))
    figures = []
    for k, t in enumerate(terms):
        fits = _fits(t.words[0], t.prefix)
        n = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(fits, F.col("at")))))) if exact else F.sum(F.when(fits, F.col("n_docs")))
        figures += [n.alias(f"n{k}"), F.sum(F.when(fits, F.col("most"))).alias(f"most{k}"), F.min(F.when(fits, F.col("least"))).alias(f"least{k}")]
    counted = cut(headers.groupBy("segment", "block").agg(*figures))  # a row for each block of any word
    held = counted.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(len(terms)))).first()
    idf = [inverse_frequency(index.n, h) for h in held]
    bound = F.lit(0.0)
    for k, i in enumerate(idf):
        f = F.col(f"most{k}")
        bound += F.lit(i) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(f"least{k}") / F.lit(index.mean or 1.0)))
    possible = cut(counted.select("segment", "block", (bound * (1 + 1e-9)).alias("bound")).where("bound > 0"))  # null unless the block has all words

    def scores(chosen: DataFrame) -> DataFrame:
        few = chosen.select("segment", "block").limit(LISTED + 1).collect()
        own = blocks.where(_listed(few, "block")) if len(few) <= LISTED else blocks.join(chosen.select("segment", "block"), ["segment", "block"], "left_semi")
        return _scored(_counts(index, own, terms, weights), idf, index.mean)

    first = possible.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS * limit)
    worst = cut(scores(first).orderBy("score").limit(limit)).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("s")).first()
    return scores(possible.where(F.col("bound") >= F.lit(-worst["s"])) if worst["n"] == limit else possible)


def compact(spark: SparkSession, source: str, target: str, postings_per_file: int = 200_000) -> int:
    """One segment of the live rows of an index, in as few files as its blocks of postings need; returns their number.

    Postings are merged as they are, with the new numbers of their documents, which fill blocks. These numbers come by
    broadcast while those that are gone are in few blocks.
    """
    index, postings = Index(spark, source), _read(spark, source, "postings")
    columns = postings.schema["most"].dataType.names
    moved = cut(index.moved())
    few = index.n_gone <= MOST_GONE and moved.where(F.col("rank").isNotNull()).count() * BLOCK <= MOST_MOVED
    with_new = lambda df: df.join(F.broadcast(moved) if few else moved, ["segment", "block"])
    place = lambda at: F.when(F.col("rank").isNull(), at).otherwise(F.get("rank", at).cast("int") - 1)

    rows_path, at = _segment(target, "rows", 0), (F.col("doc") % BLOCK).cast("int")
    rows = with_new(index.rows.withColumn("block", F.shiftright("doc", BLOCK_BITS))).withColumn("at", place(at)).where("at >= 0")
    _write(rows.select((F.col("offset") + F.col("at")).alias("doc"), *(c for c in index.rows.columns if c not in ("doc", "segment"))), rows_path, PAGE_ROWS)

    files = max(1, -(-postings.count() // postings_per_file), -(-index.tokens // FILE_TOKENS))
    places = _places_of_postings(postings, index.tokens, files) if files > 1 else None
    again = lambda h: F.struct(place(h["at"]).alias("at"), h["c"].alias("c"), h["z"].alias("z"), h["positions"].alias("positions"))
    live = F.transform(F.filter("held", lambda h: F.get("rank", h["at"]) > 0), again)
    held = F.when(F.col("rank").isNull(), F.col("held")).otherwise(live) if index.any_gone else F.col("held")
    given = with_new(postings.select("segment", "term", "block", "held")).select("term", "offset", held.alias("held"))
    _write_postings(given, held_postings.from_postings(BLOCK_BITS, PART_TOKENS, places, files), columns, target, 0, files)
    _write_figures(spark.read.parquet(rows_path), target, 0, None)
    return files
