"""The data source of file trees: what can be read, what cannot, and streams of what is new."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quire.sources import trees


@pytest.fixture
def root(tmp_path):
    for name, body in (("a/x.pdf", b"one"), ("a/b/c/y.txt", b"22"), ("z.JPG", b"3"), ("a/empty.tif", b""), ("a/.hidden", b"h"), ("_d/in.txt", b"i")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "a/gone.pdf").symlink_to(tmp_path / "nowhere")
    (tmp_path / "a/bad.pdf").symlink_to("/proc/self/mem")  # a regular file whose bytes cannot be read, even by root
    (tmp_path / "a/loop").symlink_to(tmp_path)  # links to folders are not followed
    os.mkfifo(tmp_path / "pipe")
    return tmp_path


def found(df, root):
    return {(r.path.removeprefix(f"file:{root}/"), r.kind, r["size"], r.content and bytes(r.content)) for r in df.collect()}


def test_every_file_is_a_row(spark, root):
    want = {("a/x.pdf", "file", 3, None), ("a/b/c/y.txt", "file", 2, None), ("z.JPG", "file", 1, None), ("a/empty.tif", "file", 0, None), ("a/gone.pdf", "vanished", None, None), ("a/bad.pdf", "unreadable", 0, None)}
    assert found(trees.tree(spark, str(root)), root) == want
    assert found(trees.tree(spark, f"file://{root}", hidden=True), root) == want | {("a/.hidden", "file", 1, None), ("_d/in.txt", "file", 1, None)}
    whole = trees.tree(spark, str(root), contents=True)
    assert found(whole.where("kind = 'file'"), root) == {("a/x.pdf", "file", 3, b"one"), ("a/b/c/y.txt", "file", 2, b"22"), ("z.JPG", "file", 1, b"3"), ("a/empty.tif", "file", 0, b"")}
    assert trees.verdicts(whole).first().asDict() == {"files_seen": 5, "unreadable": 1, "directory_errors": 0, "vanished": 1, "root_unreadable": False, "completed": True, "is_clean": False}


def test_a_root_that_is_not_there(spark, tmp_path):
    rows = trees.tree(spark, str(tmp_path / "none"))
    assert [(r.kind, r.reason) for r in rows.collect()] == [("rootUnreadable", "No such file or directory")]
    said = trees.verdicts(rows).first()
    assert said["root_unreadable"] and not said["completed"] and not said["is_clean"] and said["directory_errors"] == 0
    (tmp_path / "empty").mkdir()
    assert trees.tree(spark, str(tmp_path / "empty")).count() == 0 and trees.verdicts(trees.tree(spark, str(tmp_path / "empty"))).first()["is_clean"]
    with pytest.raises(Exception, match="not on a mounted"):
        trees.tree(spark, "s3://bucket/x").count()


def rows_of(root, **how):
    parts = trees.dealt(str(root), False, **how)
    return [r for p in parts for r in (p.rows if isinstance(p, trees.Found) else trees.walk(p, False, False))]


def test_folders_that_cannot_be_entered(root, monkeypatch):
    """One folder is closed, at any depth of the walk; all others are seen. One that goes during the scan is no error."""
    real = os.scandir

    def scandir(path):
        if str(path).endswith("/b"):
            raise PermissionError(13, "Permission denied")
        if str(path).endswith("/c"):
            raise FileNotFoundError(2, "No such file or directory")
        return real(path)

    (root / "d/c").mkdir(parents=True)
    monkeypatch.setattr(os, "scandir", scandir)
    for folders in (1, 2, 3, 64):
        monkeypatch.setattr(trees, "FOLDERS", folders)
        kinds = {(r[0].removeprefix(f"file:{root}/"), r[1]) for r in rows_of(root)}
        assert kinds == {("a/x.pdf", "file"), ("z.JPG", "file"), ("a/empty.tif", "file"), ("a/gone.pdf", "vanished"), ("a/bad.pdf", "unreadable"), ("a/b", "directoryError"), ("d/c", "vanished")}


def test_files_that_cannot_be_examined(root, monkeypatch):
    real = os.stat

    def stat(path, **how):
        if str(path).endswith("x.pdf"):
            raise PermissionError(13, "Permission denied")
        return real(path, **how)

    monkeypatch.setattr(os, "stat", stat)
    assert [r[1:] for r in rows_of(root) if r[0].endswith("x.pdf")] == [("unreadable", None, None, "Permission denied", None)]


def test_wide_and_deep_trees_are_dealt_to_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"d{i % 100}/e{i}/f").mkdir(parents=True)
        (tmp_path / f"d{i % 100}/e{i}/f/{i}.txt").write_text("x" * i)
    rows = trees.tree(spark, str(tmp_path))
    assert rows.where("kind = 'file'").count() == 200 and rows.agg(F.sum("size")).first()[0] == sum(range(200))
    assert 64 <= rows.rdd.getNumPartitions() <= 300


def test_a_stream_gives_what_is_new(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()

    def run():
        time.sleep(trees.SETTLED_NS / 1e9 + 0.3)
        stream = trees.tree_stream(spark, str(root), contents=True).select("path", "kind", "size", F.decode("content", "UTF-8").alias("said"))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="1 second").start()
        try:
            time.sleep(4)
        finally:
            query.stop()
        return sorted((r.path.rsplit("/", 1)[1], r.kind, r.said) for r in spark.read.parquet(out).collect())

    (root / "a.txt").write_text("1")
    assert run() == [("a.txt", "file", "1")]
    (root / "b.txt").write_text("2")
    (root / "moved.txt").write_text("3")
    os.utime(root / "moved.txt", (0, 0))  # an old time of content, but it came now
    assert run() == [("a.txt", "file", "1"), ("b.txt", "file", "2"), ("moved.txt", "file", "3")]
