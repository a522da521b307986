"""The index as one object: methods by name, a result cache, plugins and projects.

`call` takes a method's name and parameters and answers with JSON-ready rows, as
a daemon or a tool server would pass them on; `python -m chunkloom.engine`
is the command line over it.
"""

from __future__ import annotations

import argparse
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import embed, scalar
from chunkloom.operators import catalogue, entities, fulltext, graph, ranking, relations, sections
from chunkloom.operators import chunks as C
from chunkloom.sources import chunkers, files
from chunkloom.sources.store import Store


class QueryCache:
    """Answers by key for a time; beyond the size, the oldest go."""

    def __init__(self, seconds: float = 10.0, size: int = 256, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.size, self.clock = seconds, size, clock
        self.held: OrderedDict[str, tuple[float, Any]] = OrderedDict()

    def get(self, key: str) -> Any:
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.seconds:
            self.held.pop(key, None)
            return None
        return value

    def put(self, key: str, value: Any) -> None:
        self.held.pop(key, None)
        self.held[key] = (self.clock(), value)
        while len(self.held) > self.size:
            self.held.popitem(last=False)

    def clear(self) -> None:
        self.held.clear()


@dataclass
class Plugins:
    """Callables that take part: `pre_search` changes queries, a `layer` adds results, `post_index` sees new chunks."""

    pre_search: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    layers: list[Callable[[DataFrame, DataFrame], DataFrame]] = field(default_factory=list)
    post_index: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


class Engine:
    """An index in a versioned store."""

    def __init__(self, spark: SparkSession, root: str, plugins: Plugins | None = None, provider: embed.Provider | None = None):
        self.spark, self.store, self.provider = spark, Store(spark, root), provider
        self.plugins, self.cache = plugins or Plugins(), QueryCache()

    # writing
    def index(self, root: str, ignore: list[str] | None = None) -> dict[str, int]:
        """Indexes the files under a folder; unchanged files are skipped, vanished ones buried."""
        found = files.walk(self.spark, root, ignore)
        known = self.store.read("files") if self.store.exists("files") else found.select("path", "language", "size", "mtime", "hash").limit(0)
        status = C.diff(known, found).groupBy("status").count().collect()
        fresh = files.changed(found, known)
        cut = chunkers.chunks(fresh).withColumn("is_deleted", F.lit(False))
        for hook in self.plugins.post_index:
            cut = hook(cut)
        if self.store.exists("chunks"):
            old = self.store.read("chunks")
            gone = known.join(found.select("path"), "path", "left_anti").select(F.col("path").alias("file_path"))
            dead = old.join(gone, "file_path", "left_semi").withColumn("is_deleted", F.lit(True))
            kept = old.join(fresh.select(F.col("path").alias("file_path")), "file_path", "left_anti").join(gone, "file_path", "left_anti")
            cut = kept.unionByName(dead).unionByName(cut, allowMissingColumns=True)
        self.store.replace("chunks", cut)
        self.store.replace("files", found.select("path", "language", "size", "mtime", "hash"))
        self._derive()
        self.cache.clear()
        return {r["status"]: r["count"] for r in status}

    def _derive(self) -> None:
        """Entities, edges, dependencies, hints and, with a provider, vectors of the live chunks."""
        rows = self.chunks()
        code = rows.where(F.col("source_type") == "code")
        self.store.replace("entities", entities.upsert(entities.symbols(rows)).withColumn("id", F.xxhash64("canonical_name")))
        calls = sections.call_edges(code.withColumn("file_path", F.concat(F.lit("p/"), "file_path"))).select("src", "dst", F.lit("calls").alias("rel_type"))
        holds = graph.contains_edges(code).select("src", "dst", F.lit("contains").alias("rel_type"))
        self.store.replace("edges", calls.unionByName(holds).unionByName(relations.import_edges(code)))
        known = self.store.read("entities")
        own = known.where(F.col("chunk_id").isNotNull()).select(F.col("chunk_id").alias("c"), F.col("id").alias("e"))
        a, b = own.select(F.col("c").alias("src"), F.col("e").alias("source_entity")), own.select(F.col("c").alias("dst"), F.col("e").alias("target_entity"))
        linked = self.store.read("edges").join(a, "src").join(b, "dst").select("source_entity", "target_entity", F.col("rel_type").alias("dep_type"))
        deps = linked.unionByName(relations.structural_deps(relations.structural(code), known)).distinct().withColumns({"valid_from": F.current_timestamp(), "valid_to": F.lit(None).cast("timestamp")})
        over = graph.overrides(deps, known).select(F.col("src").alias("source_entity"), F.col("dst").alias("target_entity"), F.lit("overrides").alias("dep_type"), F.current_timestamp().alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
        self.store.replace("dependencies", deps.unionByName(over))
        self.store.replace("hints", entities.template_hints(rows).select("chunk_id", "hint_text", F.lit("symbol").alias("hint_type")))
        if self.provider:
            self.embed()

    def embed(self) -> int:
        """Vectors of the live chunks that have none, by the provider; gives how many there were."""
        if not self.provider:
            raise ValueError("no provider of vectors")
        schema = "chunk_id long, embedding array<float>, dimensions int, model string, created_at timestamp"
        held = self.store.read("vectors") if self.store.exists("vectors") else self.spark.createDataFrame([], schema)
        some = embed.unembedded(self.chunks(), held)
        made = embed.embedded(some, "content_raw", self.provider).select(F.col("id").alias("chunk_id"), "embedding", F.lit(self.provider.dimensions).alias("dimensions"), F.lit(self.provider.model).alias("model"), F.current_timestamp().alias("created_at"))
        self.store.replace("vectors", embed.stored(held, made))
        return some.count()

    def ingest(self, rows: list[dict]) -> int:
        """Adds knowledge rows; those whose content is there already only raise its importance.  Gives how many were new."""
        new = files.knowledge(self.spark, rows)
        base = self.store.read("chunks") if self.store.exists("chunks") else None
        if base is None:
            base = self.spark.createDataFrame([], "id long, file_path string, content_hash string, source_type string, content_raw string, chunk_type string, name string, importance double, is_deleted boolean")
        took = C.ingest(base, new, F.current_timestamp())
        added = took.where("added").drop("added", "last_accessed").withColumn("is_deleted", F.lit(False))
        raised = took.where("not added").select("id", F.col("importance").alias("_i"))
        old = base.join(raised, "id", "left").withColumn("importance", F.greatest("importance", "_i")).drop("_i")
        n = added.count()
        self.store.replace("chunks", old.unionByName(added, allowMissingColumns=True))
        self.cache.clear()
        return n

    def forget(self, ids: list[int]) -> None:
        all_ = self.store.read("chunks")
        if "deleted_at" not in all_.columns:
            all_ = all_.withColumn("deleted_at", F.lit(None).cast("timestamp"))
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id long")
        self.store.replace("chunks", C.forget(all_, wanted, F.current_timestamp()))
        self.cache.clear()

    # reading
    def chunks(self) -> DataFrame:
        return self.store.read("chunks").where(~F.col("is_deleted"))

    def search(self, query: str, top_k: int = 10, **filters) -> DataFrame:
        """Chunks by content; filters as `catalogue.ls` takes them apply before ranking."""
        rows = catalogue.ls(self.chunks(), **filters)
        for column, kind in (("updated_at", "timestamp"), ("signature", "string"), ("line_start", "long"), ("line_end", "long")):
            if column not in rows.columns:  # knowledge alone has no places
                rows = rows.withColumn(column, F.lit(None).cast(kind))
        queries = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        for hook in self.plugins.pre_search:
            queries = hook(queries)
        found = fulltext.content_search(rows, queries, F.current_timestamp(), top_k).select("query_id", "id", "score")
        for layer in self.plugins.layers:
            extra = layer(rows, queries).select("query_id", "id", F.col("score").alias("_s"))
            found = found.join(extra, ["query_id", "id"], "full_outer").select("query_id", "id", F.greatest("score", "_s").alias("score"))
        out = found.join(rows.select("id", "file_path", "name", "chunk_type", "line_start", "line_end", "content_raw", "importance"), "id")
        out = ranking.dampen(out.withColumn("score", scalar.importance_boost(F.col("score"), F.col("importance"))))
        return fulltext.top(out, top_k, F.desc(F.round("score", 9)), F.col("id"))

    def context(self, query: str, max_tokens: int = 8000, top_k: int = 10) -> DataFrame:
        """Search results that fit a budget of estimated tokens, the first always."""
        out = self.search(query, top_k).withColumn("tokens", scalar.token_estimate(F.col("content_raw")))
        return ranking.within_budget(out, max_tokens, "tokens", "query_id", F.desc(F.round("score", 9)), F.col("id"))

    def vector_search(self, query: str, top_k: int = 10) -> DataFrame:
        """Chunks whose vectors lie nearest to that of a text."""
        if not self.provider:
            raise ValueError("no provider of vectors")
        asked = embed.embedded(self.spark.createDataFrame([(-1, query)], "id long, text string"), "text", self.provider, "v").select("id", "v")
        v = self.store.read("vectors").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))
        near = ranking.nearest(v.join(self.chunks().select("id"), "id", "left_semi"), asked, top_k, "cosine")
        return near.join(self.chunks().select("id", "file_path", "name"), "id").orderBy("distance", "id")

    def entities(self, entity_type: str | None = None, top_k: int = 50) -> DataFrame:
        rows = self.store.read("entities")
        rows = rows.where(F.col("entity_type") == entity_type) if entity_type else rows
        return rows.orderBy(F.desc("mentions"), "canonical_name").limit(top_k)

    def entity_deps(self, name: str, hops: int = 1) -> DataFrame:
        """Entities that one depends on within some hops, with their distance."""
        rows = self.store.read("entities").select("id", "canonical_name", "entity_type")
        seed = rows.where(F.col("canonical_name") == name.strip().lower()).select(F.col("id").alias("node"))
        found = graph.reached(graph.entity_edges(self.store.read("dependencies")), seed, hops)
        return found.join(rows.select(F.col("id").alias("node"), "canonical_name", "entity_type"), "node").orderBy("depth", "canonical_name")

    def hints(self, chunk_id: int) -> DataFrame:
        return self.store.read("hints").where(F.col("chunk_id") == chunk_id)

    def communities(self) -> DataFrame:
        return entities.directory_communities(self.chunks(), self.store.read("entities")).orderBy("path")

    def episodes(self, path: str | None = None, top_k: int = 20) -> DataFrame:
        rows = self.store.read("episodes")
        rows = rows.where(F.col("file_path") == path) if path else rows
        return rows.orderBy(F.desc("created_at"), "id").limit(top_k)

    def file_deps(self, path: str, hops: int = 1) -> DataFrame:
        """Files that a file depends on, directly or within some hops."""
        edges = self.store.read("edges").where(F.col("rel_type").isin("imports", "calls"))
        return relations.transitive_files(edges, self.chunks(), hops).where(F.col("source") == path).orderBy("depth", "target")

    def render(self, ids: list[int]) -> str:
        """Chunks as one Markdown text, in the given order."""
        wanted = self.spark.createDataFrame([(0, i, n) for n, i in enumerate(ids)], "query_id long, id long, place int")
        row = catalogue.rendered(wanted, self.chunks()).first()
        return row["text"] if row else ""

    def deps(self, path: str) -> DataFrame:
        """What the chunks of a file call, and who calls them."""
        from chunkloom.operators.sections import call_edges

        rows = self.chunks().where(F.col("source_type") == "code")
        own = rows.where(F.col("file_path") == path).select("id")
        edges = call_edges(rows.withColumn("file_path", F.concat(F.lit("p/"), "file_path")))
        out = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").select(F.lit("calls").alias("way"), F.col("dst").alias("id"))
        into = edges.join(own.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.lit("called_by").alias("way"), F.col("src").alias("id"))
        return out.unionByName(into).join(rows.select("id", "file_path", "name"), "id").orderBy("way", "file_path", "id")

    def get(self, path: str, line: int) -> DataFrame:
        place = self.spark.createDataFrame([(path, line)], "path string, line int")
        return catalogue.get(self.chunks(), place).join(self.chunks(), "id")

    def stats(self) -> DataFrame:
        return catalogue.counts(self.chunks(), "source_type", "chunk_type").orderBy(F.desc("n"), "chunk_type")

    def call(self, method: str, **params) -> dict:
        """{"ok", "result"} or {"ok", "error"} of a method; searches and context are cached for a while."""
        allowed = {"index": self.index, "ingest": self.ingest, "forget": self.forget, "search": self.search, "context": self.context, "deps": self.deps, "get": self.get, "stats": self.stats, "embed": self.embed, "vector_search": self.vector_search, "entities": self.entities, "entity_deps": self.entity_deps, "hints": self.hints, "communities": self.communities, "episodes": self.episodes, "file_deps": self.file_deps, "render": self.render, "tree": lambda: catalogue.tree(self.chunks().select(F.col("file_path").alias("path"))).orderBy("path"), "project_summary": lambda: catalogue.counts(self.chunks(), "language").orderBy("language"), "ls": lambda **f: catalogue.ls(self.chunks(), **f).select("id", "file_path", "name", "chunk_type", "line_start").orderBy("file_path", "line_start"), "cat": lambda id: self.chunks().where(F.col("id") == id)}
        if method not in allowed:
            return {"ok": False, "error": f"unknown method {method}"}
        key = json.dumps([method, params], sort_keys=True, default=str)
        if method in ("search", "context") and (held := self.cache.get(key)) is not None:
            return {"ok": True, "result": held}
        try:
            out = allowed[method](**params)
            if isinstance(out, DataFrame):
                out = [r.asDict(recursive=True) for r in out.toLocalIterator()]
        except Exception as e:  # the caller gets the reason, not a broken connection
            return {"ok": False, "error": f"{type(e).__name__}: {e}"[:500]}
        if method in ("search", "context"):
            self.cache.put(key, out)
        return {"ok": True, "result": out}


def across(engines: dict[str, Engine], query: str, top_k: int = 10) -> DataFrame:
    """The best results of several indexes, with their project."""
    out = None
    for name, engine in engines.items():
        one = engine.search(query, top_k).select(F.lit(name).alias("project"), "id", "file_path", "name", "score")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("score"), "project", "id").limit(top_k)


__all__ = ["Engine", "Plugins", "QueryCache", "across", "graph"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chunkloom")
    parser.add_argument("method")
    parser.add_argument("--store", required=True)
    parser.add_argument("--params", default="{}", help="the method's parameters as JSON")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("chunkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    answer = Engine(spark, args.store).call(args.method, **json.loads(args.params))
    print(json.dumps(answer, default=str, ensure_ascii=False))
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
