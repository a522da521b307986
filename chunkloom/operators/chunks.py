"""The state of chunks that were delivered, tombstoned and revived in several rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import scalar


#: Characters of a session's summary.
SUMMARY = 4000


def latest(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: that with the greatest updated_at (null is lowest), a deleted one on a tie."""
    # a window, not an aggregate of whole rows: columns that nobody asks for are pruned down to the scan
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("updated_at"), F.desc(F.coalesce("is_deleted", F.lit(False))))
    return rows.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def live(rows: DataFrame) -> DataFrame:
    """The latest rows that are not deleted."""
    return latest(rows).where(~F.coalesce("is_deleted", F.lit(False)))


def tombstone(chunks: DataFrame, paths: DataFrame, at: Column) -> DataFrame:
    """Code chunks of the given files (column path) as deleted; their updated_at and deleted_at are `at`."""
    hit = chunks.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").where((F.col("source_type") == "code") & ~F.col("is_deleted"))
    return hit.withColumns({"is_deleted": F.lit(True), "deleted_at": at, "updated_at": at})


def cascade(children: DataFrame, chunk_id: str, dead: DataFrame) -> DataFrame:
    """Child rows without those of dead chunks (column id); rows without a chunk stay."""
    return children.join(dead.select(F.col("id").alias(chunk_id)).distinct(), chunk_id, "left_anti").select(*children.columns)


def purge(chunks: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Chunks without tombstones older than `days`."""
    old = F.col("is_deleted") & (F.coalesce("deleted_at", "updated_at") < as_of - F.make_dt_interval(F.lit(days)))
    return chunks.where(~F.coalesce(old, F.lit(False)))


def forget(chunks: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """All chunks, knowledge rows of the given ids (column id) deleted; code stays."""
    wanted = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("source_type") != "code")
    out = chunks.join(wanted, "id", "left")
    return out.withColumns({"is_deleted": F.col("is_deleted") | hit, "deleted_at": F.when(hit, at).otherwise(F.col("deleted_at"))}).drop("_hit")


def modify(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks with importance and tags of `changes` (id, importance, tags) where those are not null; knowledge only."""
    new = changes.select("id", F.col("importance").alias("_i"), F.col("tags").alias("_t"))
    own = F.col("source_type") != "code"
    out = chunks.join(new, "id", "left")
    return out.withColumns({"importance": F.when(own, F.coalesce("_i", "importance")).otherwise(F.col("importance")), "tags": F.when(own, F.coalesce("_t", "tags")).otherwise(F.col("tags"))}).drop("_i", "_t")


def ingest(chunks: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """Knowledge rows to add or touch: one per live (content hash, source type), with the greatest importance.

    A row whose content is there already keeps that chunk's id and importance,
    raised to the new one; others get an id from their content.
    """
    hashed = rows.withColumn("content_hash", scalar.content_hash(F.col("content_raw")))
    one = hashed.groupBy("content_hash", "source_type").agg(F.max("importance").alias("importance"), F.min(F.struct("content_raw", "chunk_type", "name")).alias("x"))
    there = chunks.where(~F.col("is_deleted")).groupBy("content_hash", "source_type").agg(F.min("id").alias("old_id"), F.max("importance").alias("old"))
    out = one.join(there, ["content_hash", "source_type"], "left")
    return out.select(F.coalesce("old_id", F.xxhash64("content_hash", "source_type")).alias("id"), "content_hash", "source_type", "x.content_raw", "x.chunk_type", "x.name", F.greatest("importance", "old").alias("importance"), F.col("old_id").isNull().alias("added"), at.alias("last_accessed"))


def diff(before: DataFrame, after: DataFrame, key: str = "path", content: str = "hash") -> DataFrame:
    """key and status (added, updated, unchanged, removed) between two states of a table with one row a key."""
    a, b = before.select(key, F.col(content).alias("a")), after.select(key, F.col(content).alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def session_summary(rows: DataFrame, session: str) -> DataFrame:
    """For each session of several rows: its common path prefix and a summary of `name: first 200 characters` lines, 4000 characters at most.

    Only the rows that the summary shows, the first by id, give their lines: no
    more than 4000 / 3 of them can, however many a session has.
    """
    nth = F.row_number().over(Window.partitionBy(session).orderBy("id"))
    line = F.when(F.col("_nth") <= SUMMARY // 3 + 1, F.concat(F.coalesce("name", F.lit("item")), F.lit(": "), F.substring("content_raw", 1, 200)))
    g = rows.withColumn("_nth", nth).groupBy(session).agg(F.count("*").alias("n"), F.min("file_path").alias("lo"), F.max("file_path").alias("hi"), F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("id", line.alias("line"))))).alias("lines"), F.collect_set("id").alias("members"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.length("lo"), F.length("hi"))), lambda k: F.substring(F.col("lo"), F.lit(1), k) == F.substring(F.col("hi"), F.lit(1), k))
    text = F.substring(F.array_join(F.col("lines.line"), "\n"), 1, SUMMARY)
    return g.where("n > 1").select(session, F.substring(F.col("lo"), F.lit(1), F.array_max(same)).alias("prefix"), text.alias("summary"), F.array_sort("members").alias("members"))
