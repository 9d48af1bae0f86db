"""Session helpers shared by every operator."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, read by Spark only (the folder may be in a remote store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where none is named, a local one if all of Spark runs in this process, as in tests."""
    sc = spark.sparkContext
    set_to = sc.getCheckpointDir()
    if set_to:
        return set_to
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quire-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name below the shared one, for what a query writes and reads again."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is executed within loses its shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that a query has written for itself, in any store that Spark reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
