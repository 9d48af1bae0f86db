"""State of streams as logs in a shared folder: what each batch adds, so that a batch that runs again replaces its own part.

A log has a folder for each batch. Every COMPACT batches one holds the whole state, and later batches read from there on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT = 20


def entries(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """Entries of the batches before a number, from the last whole state on, with the batch of each. A path without any has none."""
    try:
        log = spark.read.schema(f"{schema}, whole boolean, batch long").option("basePath", path).parquet(f"{path}/whole=*/batch=*").where(F.col("batch") < before)
    except Exception as missing:  # the first batch finds no log
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
    last = log.where("whole").agg(F.max("batch")).first()[0]
    return (log if last is None else log.where(F.col("batch") >= last)).drop("whole")


def write(rows: DataFrame, path: str, number: int, state: DataFrame | None = None) -> None:
    """The entries of a batch; with the whole state, which then has to hold them too, in their place every COMPACT batches."""
    whole = state is not None and number % COMPACT == COMPACT - 1
    (state if whole else rows).write.mode("overwrite").parquet(f"{path}/whole={str(whole).lower()}/batch={number}")


def run(stream: DataFrame, schema: str, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]], state_path: str, out_path: str, checkpoint: str, interval: str | None = None):
    """Starts a query: step takes a batch and the entries so far and returns new entries, the whole state after them, and results.

    Results of each batch go to a folder of its own below out_path, which a rerun overwrites. The query ends when it has
    read what is there, or goes on with a batch each interval ("30 seconds").
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            new, state, made = step(batch, entries(batch.sparkSession, state_path, schema, number))
            write(new, state_path, number, state)
            made.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        finally:
            batch.unpersist()

    when = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**when).start()
