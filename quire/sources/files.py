"""Scans of file trees, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut
from quire.sources import trees

# Extensions that are accepted.
ACCEPTED = "jpg jpeg png tiff tif heic pdf".split()


def fingerprints(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, modified and size of every file below a root that has content, in any store; contents are not read.

    Spark's reader lists no empty files; quire.sources.trees does, on file systems that are mounted.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def scan(spark: SparkSession, root: str, cancelled: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted files with their bytes, what went wrong (path, problem, reason), and one row of verdicts.

    The tree is passed over once for problems and verdicts, which opens every file; the bytes are read with the rows.
    Files that cannot be read are problems, not rows, and fail nothing; empty files are rows.
    """
    seen = cut(trees.tree(spark, root))
    problems = seen.where(F.col("kind") != trees.FILE).select("path", F.col("kind").alias("problem"), "reason")
    rows = trees.tree(spark, root, contents=True).where((F.col("kind") == trees.FILE) & accepted(F.col("path")))
    return rows.select("path", "content", "modified", "size"), problems, trees.verdicts(seen, cancelled)


def accepted(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1)).isin(*ACCEPTED)


def inspect(exists: Column, is_directory: Column, is_link: Column, is_regular: Column, readable: Column, tracked: Column) -> Column:
    """What one path is."""
    return F.when(~exists, "vanished").when(is_link, "symlink").when(is_directory, "directory").when(~is_regular, "nonRegular").when(~readable, "unreadable").when(tracked, "tracked").otherwise("untracked")


def read_jsonl(spark: SparkSession, paths) -> DataFrame:
    """custom_id, text and error of batch results, one JSON per line; bad lines are skipped, the last line of an id wins.

    The three shapes of the providers are read alike: the text is in the response's choices, candidates or content. Lines
    are in the order of their files' paths, and of their places in them, however Spark deals files to tasks.
    """
    read = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return parse_jsonl(read.select("value", F.struct("file", "block", "row").alias("n")))


#: What is read of a line, in any of the three shapes.
ANSWER = """custom_id string, key string, error struct<message: string>,
response struct<body: struct<choices: array<struct<message: struct<content: string>>>>, candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>, error: struct<message: string>>,
result struct<message: struct<content: array<struct<text: string>>>, error: struct<message: string>>"""


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """lines: value and n, the order of lines (any type with an order). All text parts of an answer are joined by line breaks."""
    parts = lambda c: F.when(F.size(F.filter(c, lambda p: p["text"].isNotNull())) > 0, F.array_join(F.transform(c, lambda p: p["text"]), "\n"))
    r = F.from_json("value", ANSWER)
    one = lines.select(r.alias("r"), "n").select(
        F.coalesce("r.custom_id", "r.key").alias("custom_id"),
        F.coalesce(F.get("r.response.body.choices", F.lit(0))["message"]["content"], parts(F.get("r.response.candidates", F.lit(0))["content"]["parts"]), parts(F.col("r.result.message.content"))).alias("text"),
        F.coalesce("r.error.message", "r.response.error.message", "r.result.error.message").alias("error"),
        "n",
    ).where("custom_id IS NOT NULL")
    last = one.groupBy("custom_id").agg(F.max_by(F.struct("text", "error"), "n").alias("r"))
    return last.select("custom_id", F.col("r.text").alias("text"), F.coalesce("r.error", F.when(F.col("r.text").isNull(), "no_result")).alias("error"))


def segment_json(date: Column, subjects: Column, pages: Column) -> Column:
    """JSON of a document: its date, subjects in title case and its pages (structs file, text), each under a mark with its file."""
    from quire.functions.text import capitalize_first_letters

    body = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("[Image: "), p["file"], F.lit("]\n"), F.coalesce(p["text"], F.lit("")))), "\n\n")
    return F.to_json(F.struct(date.alias("date"), F.transform(subjects, capitalize_first_letters).alias("subjects"), body.alias("body")))


def write_by_collection(rows: DataFrame, path: str) -> None:
    """One folder per collection; files are dealt by collection first, so that each folder gets few."""
    rows.repartition("collection").write.mode("overwrite").partitionBy("collection").parquet(path)


def write_organization(folders: DataFrame, memberships: DataFrame, path: str) -> None:
    """The folder graph as JSON lines."""
    folders.write.mode("overwrite").json(f"{path}/folders")
    memberships.write.mode("overwrite").json(f"{path}/memberships")


def read_organization(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    folders = spark.read.schema("folder_id long, parent_id long, name string, sort_order int, kind string, query_json string").json(f"{path}/folders")
    return folders, spark.read.schema("item_id long, folder_id long, added_at timestamp").json(f"{path}/memberships")
