"""File trees as a data source: every file below a root with its size and times, and a row for whatever could not be read.

    spark.dataSource.register(FileTree)
    spark.read.format("filetree").option("contents", "true").load("/mnt/archive")

Spark's own file reader fails a job at the first file that it cannot read, lists no empty files and says nothing of
folders that it may not enter. Here each of these is a row, by its kind: file, unreadable (a file), directoryError,
vanished (listed, then gone) or rootUnreadable. A scan is judged by these rows, so a pass that saw less than everything can be
told from one that saw everything.

The root's upper levels are listed to find enough folders for the tasks, which then walk their own; a stream's offsets are times, and each
batch lists the files that changed or came between two of them. Paths are those of a file system that is mounted on all machines.
"""

from __future__ import annotations

import os
import stat as stats
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, kind string, size long, modified timestamp, reason string, content binary"
FILE, UNREADABLE, DIRECTORY_ERROR, VANISHED, ROOT_UNREADABLE = "file", "unreadable", "directoryError", "vanished", "rootUnreadable"
#: Folders are listed level by level until there are so many to deal out.
FOLDERS = 64
#: Rows and bytes of content in a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Files that changed so short a time ago may still be written; a stream leaves them to the next batch.
SETTLED_NS = 2_000_000_000
ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("reason", pa.string()), ("content", pa.binary())])


@dataclass
class Folders(InputPartition):
    """Folders to walk, or (deep is false) to list without going down; since and until bound the times of files, in ns."""

    paths: list[str]
    deep: bool = True
    since: int | None = None
    until: int | None = None


@dataclass
class Found(InputPartition):
    """Rows that planning found: what could not be listed."""

    rows: list[tuple]


def local(path: str) -> str:
    """The path without the scheme of local files."""
    for prefix in ("file://", "file:"):
        if path.startswith(prefix):
            return "/" + path[len(prefix) :].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is not on a mounted file system")
    return os.path.abspath(path)


def _reason(error: OSError) -> str:
    return error.strerror or type(error).__name__


def _row(path: str, kind: str, size=None, modified=None, reason=None, content=None) -> tuple:
    return f"file:{path}", kind, size, modified, reason, content


def children(folder: str, hidden: bool, root: bool = False) -> tuple[list[os.DirEntry], list[tuple]]:
    """Entries of a folder in order of names, or a row that says why there are none."""
    try:
        with os.scandir(folder) as entries:
            return sorted((e for e in entries if hidden or e.name[0] not in "._"), key=lambda e: e.name), []
    except OSError as error:
        kind = ROOT_UNREADABLE if root else VANISHED if isinstance(error, FileNotFoundError) else DIRECTORY_ERROR
        return [], [_row(folder, kind, reason=_reason(error))]


def is_folder(entry: os.DirEntry) -> bool:
    """Links to folders are not followed, so a walk ends."""
    try:
        return entry.is_dir(follow_symlinks=False)
    except OSError:
        return False


def examined(path: str, contents: bool, since: int | None, until: int | None) -> tuple | None:
    """The row of one path, or none if it is no regular file or not of the time asked for."""
    try:
        found = os.stat(path)
    except FileNotFoundError as error:
        return _row(path, VANISHED, reason=_reason(error))
    except OSError as error:
        return _row(path, UNREADABLE, reason=_reason(error))
    changed = max(found.st_mtime_ns, found.st_ctime_ns)
    if not stats.S_ISREG(found.st_mode) or (since is not None and changed <= since) or (until is not None and changed > until):
        return None
    modified = found.st_mtime_ns // 1000
    try:
        with open(path, "rb") as file:
            content = file.read() if contents else file.read(1)[:0] or None
    except FileNotFoundError as error:
        return _row(path, VANISHED, reason=_reason(error))
    except OSError as error:
        return _row(path, UNREADABLE, found.st_size, modified, _reason(error))
    if contents and len(content) < found.st_size:
        return _row(path, UNREADABLE, found.st_size, modified, "fewer bytes than listed")
    return _row(path, FILE, found.st_size, modified, None, content)


def walk(part: Folders, contents: bool, hidden: bool) -> Iterator[tuple]:
    todo = [*reversed(part.paths)]
    while todo:
        folder = todo.pop()
        entries, wrong = children(folder, hidden)
        yield from wrong
        down = []
        for entry in entries:
            if is_folder(entry):
                down.append(entry.path)
            elif row := examined(entry.path, contents, part.since, part.until):
                yield row
        if part.deep:
            todo += reversed(down)


def dealt(root: str, hidden: bool, since: int | None = None, until: int | None = None) -> list[InputPartition]:
    """The tree in parts: upper folders to list, lower ones to walk, and what could not be listed."""
    upper, level, wrong, first = [], [root], [], True
    while level and len(level) < FOLDERS:
        below = []
        for folder in level:
            entries, errors = children(folder, hidden, root=first)
            wrong += errors
            if not errors:
                upper.append(folder)
                below += [e.path for e in entries if is_folder(e)]
        level, first = below, False
    parts: list[InputPartition] = [Folders([folder], True, since, until) for folder in level]
    parts += [Folders(upper[k::FOLDERS], False, since, until) for k in range(min(FOLDERS, len(upper)))]
    return parts + ([Found(wrong)] if wrong else []) or [Found([])]


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5] or b"")
        if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class _Tree:
    def __init__(self, options: dict):
        self.root = local(options["path"])
        self.contents = options.get("contents", "false").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows = iter(partition.rows) if isinstance(partition, Found) else walk(partition, self.contents, self.hidden)
        return batches(rows)


class TreeReader(_Tree, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return dealt(self.root, self.hidden)


class TreeStream(_Tree, DataSourceStreamReader):
    """Files by the time of their last change, renames included; one that changes again comes again."""

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - SETTLED_NS}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return dealt(self.root, self.hidden, start["until"], end["until"])


class FileTree(DataSource):
    """Options: path; contents (false) for the bytes of files; hidden (false) for names that begin with a dot or an underscore."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)


def tree(spark: SparkSession, root: str, contents: bool = False, hidden: bool = False) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("contents", str(contents).lower()).option("hidden", str(hidden).lower()).load(root)


def tree_stream(spark: SparkSession, root: str, contents: bool = False, hidden: bool = False) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.readStream.format("filetree").option("contents", str(contents).lower()).option("hidden", str(hidden).lower()).load(root)


def verdicts(found: DataFrame, cancelled: bool = False) -> DataFrame:
    """One row of a pass: files seen, what went wrong by kind, whether it completed, and is_clean: nothing that it lacks can be unseen.

    Vanished files don't make a pass unclean: they are gone, not unseen. A pass that could not open its root saw nothing.
    """
    of = lambda kind: F.count_if(F.col("kind") == kind)
    counts = found.agg(
        F.count_if(F.col("kind").isin(FILE, UNREADABLE) & F.col("size").isNotNull()).alias("files_seen"), of(UNREADABLE).alias("unreadable"), of(DIRECTORY_ERROR).alias("directory_errors"), of(VANISHED).alias("vanished"), (of(ROOT_UNREADABLE) > 0).alias("root_unreadable")
    )
    completed = ~F.col("root_unreadable") & F.lit(not cancelled)
    return counts.select("*", completed.alias("completed"), (completed & (F.col("unreadable") + F.col("directory_errors") == 0)).alias("is_clean"))
