"""Layered search: full text, hints, entity graph, communities and vectors fused for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.common import Scratch
from chunkloom.functions import scalar
from chunkloom.operators import entities as E
from chunkloom.operators import fulltext, graph, ranking

#: Bonus of relational hint kinds, boost of chunks near a query's entities, weight of the graph layer, score of a community's chunk of importance 1.
RELATIONAL = ("caller", "callee", "heir", "member", "importer")
HINT_BONUS, NEAR_BOOST, GRAPH_WEIGHT, COMMUNITY_SCORE = 0.15, 0.15, 0.7, 0.5 * 0.6 * 0.5
#: Chunks of near entities of a query, at most.
NEAR = 50


def hint_search(hints: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, score: the best hint of each chunk (chunk_id, hint_text, hint_type), normalised, relational ones raised."""
    rows = hints.select(F.xxhash64("chunk_id", "hint_text").alias("id"), "chunk_id", "hint_text", "hint_type").groupBy("id").agg(*[F.min(c).alias(c) for c in ("chunk_id", "hint_text", "hint_type")])
    every = fulltext.asked(queries)
    found = fulltext.best(rows, fulltext.asking(every), 10 * k, {"hint_text": 1.0}, by="rank", tie="chunk_id")
    found = found.join(rows, "id")
    best = fulltext.top(found, 10 * k, F.round("rank", 9), F.col("chunk_id"), F.col("hint_text")).drop("place")
    raised = F.least(fulltext.normalised(best) + F.when(F.col("hint_type").isin(*RELATIONAL), HINT_BONUS).otherwise(0.0), F.lit(1.0))
    each = best.withColumn("score", raised).groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.max("score").alias("score"))
    return fulltext.answered(every, fulltext.top(each, k, F.desc(F.round("score", 9)), F.col("id")).drop("place"))


def text_search(chunks: DataFrame, queries: DataFrame, hints: DataFrame, near: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    """query_id, id, score: content and hint results, those near the query's entities (near: query_id, id) raised, boosted and dampened."""
    content = fulltext.content_search(chunks, queries, as_of, k).select("query_id", "id", F.col("score").alias("a"))
    hinted = hint_search(hints, queries, 2 * k).select("query_id", "id", F.col("score").alias("b"))
    both = content.join(hinted, ["query_id", "id"], "full_outer").select("query_id", "id", F.greatest("a", "b").alias("score"))
    close = near.select("query_id", "id").distinct().withColumn("close", F.lit(True))
    lifted = F.when(F.col("close"), F.least(F.col("score") + NEAR_BOOST, F.lit(1.0))).otherwise(F.col("score"))
    out = both.join(close, ["query_id", "id"], "left").withColumn("score", lifted).drop("close")
    out = out.join(chunks.select("id", "name", "file_path", "importance"), "id")
    out = ranking.dampen(out.withColumn("score", scalar.importance_boost(F.col("score"), F.col("importance"))))
    return fulltext.top(out, k, F.desc(F.round("score", 9)), F.col("id")).select("query_id", "id", "score")


def layered(chunks: DataFrame, queries: DataFrame, entities: DataFrame, attributes: DataFrame, deps: DataFrame, vectors: DataFrame, as_of: Column, k: int = 10, written: bool = False) -> DataFrame:
    """query_id, id, score, layers, place of the best k chunks of each query.

    `written` says that `chunks` is a written table already.
    `queries` has query_id and text; a query's vector is that of the chunk with
    its id, where there is one.  Layers are folded in order: full text with
    hints, then chunks of near entities that are new, then new chunks of the
    three largest communities that the query names, then nearest vectors, which
    raise what is there and add what is not.  A query whose full-text results are
    clear (three of 0.7, the best above 0.85) keeps to them.
    """
    scratch = Scratch(chunks.sparkSession, "layered")  # each layer is read several times
    chunks, queries = chunks if written else scratch.cut(chunks), scratch.cut(queries)
    entities = entities.distinct()
    hints = E.template_hints(chunks).select("chunk_id", "hint_text", F.lit("symbol").alias("hint_type"))
    related = E.relational_hints(entities, deps).join(entities.select(F.col("id").alias("entity_id"), "chunk_id"), "entity_id").where(F.col("chunk_id").isNotNull())
    hints = hints.unionByName(related.select("chunk_id", "hint_text", "hint_type"))
    boosted = scratch.cut(graph.graph_boost(entities, deps, attributes, queries, NEAR))
    first = scratch.cut(text_search(chunks, queries, hints, boosted, as_of, k))
    clear = first.groupBy("query_id").agg(((F.count_if(F.col("score") >= 0.7) >= 3) & (F.max("score") > 0.85)).alias("clear"))

    facts = chunks.select("id", "importance", "updated_at")
    added = boosted.join(first, ["query_id", "id"], "left_anti").join(facts, "id")
    added = added.select("query_id", "id", (F.col("score") * scalar.recency(F.col("updated_at"), as_of) * F.col("importance") * GRAPH_WEIGHT).alias("score"))
    two = first.unionByName(added)

    named = scratch.cut(E.matching_communities(scratch.cut(E.community_texts(chunks)), queries.join(clear.where("clear"), "query_id", "left_anti")))
    # other layers hold 3 k + NEAR chunks of a query at most; beyond so many more than k, none of a community can be among the best k
    members = E.community_chunks(chunks, named, 4 * k + NEAR, scalar.source_key(F.col("name"), F.col("file_path")))
    joined = named.join(members, "path").select("query_id", "id", (F.col("importance") * COMMUNITY_SCORE).alias("score")).distinct()
    joined = scratch.cut(joined.join(two, ["query_id", "id"], "left_anti"))
    two = two.unionByName(joined)

    v = vectors.where(F.size("embedding") > 0).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))
    asked = v.join(queries.select(F.col("query_id").alias("id")), "id", "left_semi")
    near = ranking.nearest(v.join(facts.select("id"), "id", "left_semi"), asked, 2 * k, "cosine").join(facts, "id")
    near = near.select("query_id", "id", "distance", (scalar.recency(F.col("updated_at"), as_of) * F.col("importance")).alias("weight"))
    near = scratch.cut(near)
    fused = ranking.add_vector_layer(two, near)

    marks = [first.select("query_id", "id", F.lit("fts").alias("layer")), added.select("query_id", "id", F.lit("graph").alias("layer")), joined.select("query_id", "id", F.lit("community").alias("layer")), near.select("query_id", "id", F.lit("vector").alias("layer"))]
    layers = marks[0].unionByName(marks[1]).unionByName(marks[2]).unionByName(marks[3]).groupBy("query_id", "id").agg(F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("layers"))
    out = fused.join(clear, "query_id", "left").join(layers, ["query_id", "id"]).where(~F.coalesce("clear", F.lit(False)) | F.contains("layers", F.lit("fts")))
    out = out.join(first.select("query_id", "id", F.col("score").alias("own")), ["query_id", "id"], "left").withColumn("score", F.when(F.col("clear"), F.col("own")).otherwise(F.col("score")))
    out = out.join(chunks.select("id", "name", "file_path", "importance"), "id")
    out = ranking.dampen(out.withColumn("score", scalar.importance_boost(F.col("score"), F.col("importance"))))
    return fulltext.top(out, k, F.desc(F.round("score", 9)), F.col("id")).select("query_id", "id", F.round("score", 6).alias("score"), "layers", "place")
