"""Browsing, statistics, health and upkeep of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ls(chunks: DataFrame, *, path: str | None = None, chunk_type: str | None = None, language: str | None = None, source_types: list[str] | None = None, agent_id: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Chunks that pass the given filters; each filter reaches the scan."""
    out = chunks
    for column, value in (("file_path", path), ("chunk_type", chunk_type), ("language", language), ("agent_id", agent_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if source_types:
        out = out.where(F.col("source_type").isin(*source_types))
    for prefix in exclude or []:
        out = out.where(~F.col("file_path").startswith(prefix))
    return out


def get(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """path, line, id: the most important chunk over each place (path, 1-based line); ties: the smaller id."""
    rows = chunks.select(F.col("file_path").alias("path"), "id", "importance", "line_start", "line_end")
    over = places.join(rows, "path").where((F.col("line") - 1).between(F.col("line_start"), F.col("line_end")))
    best = F.max_by("id", F.struct("importance", -F.col("id"))).alias("id")
    return over.groupBy("path", "line").agg(best)


def diff_since(chunks: DataFrame, at: Column) -> DataFrame:
    """Chunks changed after a time, with what happened; rows without updated_at never changed."""
    what = F.when(F.col("is_deleted"), "deleted").when(F.col("created_at") > at, "added").otherwise("modified")
    return chunks.where(F.col("updated_at") > at).select("id", "file_path", what.alias("change"))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def totals(chunks: DataFrame, files: DataFrame, entities: DataFrame, deps: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of totals: live chunks, files, entities, edges, embedded chunks."""
    parts = [chunks.agg(F.count("*").alias("n"), F.lit("chunks").alias("what")), files.agg(F.count_distinct("path").alias("n"), F.lit("files").alias("what")), entities.agg(F.count_distinct("id").alias("n"), F.lit("entities").alias("what")), deps.agg(F.count_distinct("id").alias("n"), F.lit("dependencies").alias("what")), chunks.join(vectors.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").agg(F.count("*").alias("n"), F.lit("embedded").alias("what"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("what", "n")


def health(chunks: DataFrame, latest: DataFrame, entities: DataFrame, attributes: DataFrame, deps: DataFrame, vectors: DataFrame) -> DataFrame:
    """what, n: tombstones, children without a live parent, chunks without a vector, doubled keys."""
    ids = chunks.select("id")
    es = entities.select("id").distinct()
    checks = {
        "tombstones": latest.where("is_deleted"),
        "attributes_without_entity": not_in(attributes, "entity_id", es, "id"),
        "attributes_without_chunk": not_in(attributes.where(F.col("chunk_id") != -1), "chunk_id", ids, "id"),
        "dependencies_without_source": not_in(deps, "source_entity", es, "id"),
        "dependencies_without_target": not_in(deps, "target_entity", es, "id"),
        "vectors_without_chunk": not_in(vectors.select("chunk_id").distinct(), "chunk_id", ids, "id"),
        "chunks_without_vector": not_in(ids, "id", vectors.select("chunk_id").distinct(), "chunk_id"),
        "doubled_entity_names": entities.groupBy("canonical_name").agg(F.count("*").alias("n")).where("n > 1"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def not_in(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null key has no parent; rows with a null key stay out, as `NOT IN` has it."""
    return rows.where(F.col(column).isNotNull()).join(parents.where(F.col(key).isNotNull()).select(F.col(key).alias(column)).distinct(), column, "left_anti")


def clean_orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows without orphans; those with a null key stay."""
    kept = rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    return kept.select(*rows.columns).unionByName(rows.where(F.col(column).isNull()))


def render(chunks: DataFrame) -> Column:
    """A chunk as Markdown."""
    title = F.coalesce("name", F.col("chunk_type"))
    head = F.format_string("### %s\n**File:** `%s` **Lines:** %d-%d **Type:** %s", title, F.col("file_path"), F.col("line_start") + 1, F.col("line_end") + 1, F.col("chunk_type"))
    return F.concat(head, F.lit("\n\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.coalesce("content_raw", F.lit("")), F.lit("\n```\n"))


def tree(paths: DataFrame) -> DataFrame:
    """path, depth, line of every folder and file of the paths, indented by depth."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    out = paths.select(F.explode(each).alias("path")).distinct().withColumn("depth", F.size(F.split("path", "/")) - 1)
    return out.withColumn("line", F.concat(F.repeat(F.lit(" "), F.col("depth") * 2), F.element_at(F.split("path", "/"), -1)))


def lines(chunks: DataFrame) -> DataFrame:
    """id, n, line of each line of content."""
    return chunks.select("id", F.posexplode(F.split("content_raw", "\n")).alias("n", "line"))


def rendered(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunks, text: the ranked chunks (query_id, id, place) as Markdown, in their order; ids without a chunk are left out.

    One query's text is put together in one task; the caller bounds its chunks.
    """
    said = ranked.join(chunks.withColumn("_said", render(chunks)).select("id", "_said"), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_said"))), lambda x: x["_said"]), "\n")
    return said.groupBy("query_id").agg(F.count("*").alias("chunks"), text.alias("text"))


def drawn(rows: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows drawn at random by a digest of their key, so the same seed draws the same rows; all where there are no more."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key), F.lit(seed))), key).limit(n)


def eval_queries(chunks: DataFrame) -> DataFrame:
    """Queries made of the names of code chunks of more than three characters, with what they should find; `write.json` stores them."""
    from chunkloom.functions import scalar

    some = chunks.where(F.col("chunk_type").isin("function", "method", "class", "interface") & (F.col("source_type") == "code") & (F.length("name") > 3))
    return some.select(scalar.name_words(F.col("name")).alias("eval_query"), F.col("id").alias("chunk_id"), "file_path", "name", "chunk_type", F.substring("content_raw", 1, 120).alias("content_preview"), F.coalesce("language", F.lit("unknown")).alias("language"))
