"""Continuous indexing from a change log.

A file stream never reads a path twice and never reports a deletion, so what is
streamed is a log of changes: small JSON files with path, kind (added, modified,
deleted), at and content.  Each micro-batch keeps the latest change of a path
and brings the store up to date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import scalar
from chunkloom.sources.store import Store

SCHEMA = "path string, kind string, at timestamp, content string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of changes of known languages."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.where(scalar.language(F.col("path")).isNotNull())


def settle(batch: DataFrame) -> DataFrame:
    """The latest change of each path in a batch."""
    latest = F.max_by(F.struct("kind", "content", "at"), F.struct("at", "kind")).alias("x")
    return batch.groupBy("path").agg(latest).select("path", "x.*")


def apply(store: Store, chunker: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that replaces the chunks of changed files, buries those of deleted ones and notes an episode for each.

    A batch that is replayed after a failure gives the same tables: rows are
    replaced by path, and episodes carry the batch's number as part of their key.
    """

    def run(batch: DataFrame, number: int) -> None:
        changes = settle(batch).persist()
        try:
            if changes.isEmpty():
                return
            fresh = chunker(changes.where((F.col("kind") != "deleted") & F.col("content").isNotNull())).withColumn("is_deleted", F.lit(False))
            if store.exists("chunks"):
                old = store.read("chunks")
                touched = changes.select(F.col("path").alias("file_path"))
                dead = old.join(changes.where(F.col("kind") == "deleted").select(F.col("path").alias("file_path")), "file_path", "left_semi").withColumn("is_deleted", F.lit(True))
                fresh = old.join(touched, "file_path", "left_anti").unionByName(dead).unionByName(fresh, allowMissingColumns=True)
            store.replace("chunks", fresh)
            notes = changes.select(F.concat(F.lit(f"{number}/"), F.col("path")).alias("id"), F.col("path").alias("file_path"), F.col("kind").alias("change_type"), F.col("at").alias("created_at"))
            store.upsert("episodes", notes, "id")
        finally:
            changes.unpersist()

    return run


def start(spark: SparkSession, folder: str, store: Store, chunker: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = False):
    """Starts the query; `once` handles what is there and ends."""
    writer = read(spark, folder).writeStream.foreachBatch(apply(store, chunker)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="200 milliseconds")).start()
