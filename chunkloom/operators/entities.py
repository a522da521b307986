"""Entities, their facts over time, provenance episodes and search hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import scalar
from chunkloom.operators.fulltext import top
from chunkloom.operators.graph import dep_type, is_open

#: Chunk types that become entities; those a community's summary lists; hint kinds of dependency types, as source and as target.
NAMED_TYPES = ("function", "method", "class", "struct", "interface", "trait", "enum", "type", "constant", "macro", "module", "impl")
KEY_ITEMS = ("function", "struct", "class", "trait", "interface", "enum", "impl", "method")
HINT_ENTITIES = ("function", "method", "class", "struct", "interface", "trait", "enum")
OUTGOING = {"implements": "heir", "extends": "heir", "overrides": "heir", "contains": "member", "calls": "callee", "references": "callee", "imports": "importer"}
INCOMING = {"implements": ("implementations of ", "", "heir"), "extends": ("subclasses of ", "", "heir"), "overrides": ("methods overridden by ", "", "heir"), "contains": ("", " members", "member"), "calls": ("callers of ", "", "caller"), "imports": ("files that import ", "", "importer"), "references": ("entities referencing ", "", "callee")}


def upsert(rows: DataFrame) -> DataFrame:
    """One entity per canonical name of rows (name, entity_type, file_path, line_start, line_end, signature, chunk_id).

    mentions counts the rows; every other column is the last non-null value in
    the order of file and line.
    """
    order = F.struct(F.coalesce("file_path", F.lit("")), F.coalesce("line_start", F.lit(-1)), F.coalesce("chunk_id", F.lit(-1)))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("name", "entity_type", "file_path", "line_start", "line_end", "signature", "chunk_id")]
    return rows.where(F.col("name").isNotNull()).groupBy(scalar.canonical(F.col("name")).alias("canonical_name")).agg(F.count("*").alias("mentions"), *last)


def symbols(chunks: DataFrame) -> DataFrame:
    """Entity rows of the named chunks and of their files."""
    named = chunks.where(F.col("chunk_type").isin(*NAMED_TYPES) & F.col("name").isNotNull())
    rows = named.select("name", F.col("chunk_type").alias("entity_type"), "file_path", "line_start", "line_end", "signature", F.col("id").alias("chunk_id"))
    files = chunks.where(F.col("source_type") == "code").select("file_path").distinct()
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("line_start", "line_end", "signature", "chunk_id")}
    return rows.unionByName(files.select(F.col("file_path").alias("name"), F.lit("file").alias("entity_type"), "file_path", *[v.alias(c) for c, v in none.items()]))


def facts_at(deps: DataFrame, at: Column) -> DataFrame:
    """Dependencies that hold at a time: valid_from <= at < valid_to, without end where that is null."""
    return deps.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def fact_history(deps: DataFrame) -> DataFrame:
    """source_entity, target_entity, dep_type, version, versions of every distinct interval of an edge, in time."""
    rows = deps.select("source_entity", "target_entity", dep_type(F.col("dep_type")).alias("dep_type"), "valid_from", "valid_to").distinct()
    edge = Window.partitionBy("source_entity", "target_entity", "dep_type")
    return rows.withColumn("version", F.row_number().over(edge.orderBy("valid_from", F.col("valid_to").asc_nulls_last()))).withColumn("versions", F.count("*").over(edge))


def current(deps: DataFrame) -> DataFrame:
    return deps.where(is_open(F.col("valid_to")))


def supersede(deps: DataFrame, edges: DataFrame, at: Column) -> DataFrame:
    """All dependencies, the open ones among `edges` (source_entity, target_entity, dep_type) closed at a time."""
    key = ["source_entity", "target_entity", "_type"]
    hit = edges.select("source_entity", "target_entity", dep_type(F.col("dep_type")).alias("_type")).distinct().withColumn("_hit", F.lit(True))
    out = deps.withColumn("_type", dep_type(F.col("dep_type"))).join(hit, key, "left")
    close = F.coalesce("_hit", F.lit(False)) & is_open(F.col("valid_to"))
    return out.withColumn("valid_to", F.when(close, at).otherwise(F.col("valid_to"))).select(*deps.columns)


def count_mentions(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Counters `mentions` by key after the rows of `new` came in."""
    more = new.groupBy(*keys).agg(F.count("*").alias("more"))
    return old.join(more, list(keys), "full_outer").select(*keys, (F.coalesce("mentions", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("mentions"))


def template_hints(chunks: DataFrame) -> DataFrame:
    """chunk_id, n, hint_text: at most five phrases about each named chunk, by name, type, first line and file."""
    n = F.trim(F.replace(F.col("name"), F.lit("_"), F.lit(" ")))
    first = F.array_join(F.slice(F.filter(F.split(F.split("content_raw", "\n")[0], r"\s+"), lambda w: w != ""), 1, 6), " ")
    words = F.size(F.filter(F.split(F.split("content_raw", "\n")[0], r"\s+"), lambda w: w != ""))
    callable_, shape = F.col("chunk_type").isin("function", "method"), F.col("chunk_type").isin("struct", "class", "interface")
    phrases = F.array(
        F.concat(F.lit("how does "), n, F.lit(" work")),
        F.concat(F.lit("where is "), n, F.lit(" defined")),
        F.concat(n, F.lit(" implementation")),
        F.when(callable_, F.concat(n, F.lit(" function"))).when(shape, F.concat(n, F.lit(" type definition"))),
        F.when(callable_, F.concat(F.lit("calling "), n, F.lit(" from"))).when(shape, F.concat(n, F.lit(" methods"))),
        F.when(words >= 3, first),
        F.concat(F.lit("code in "), F.element_at(F.split("file_path", "/"), -1)),
    )
    kept = F.slice(F.filter(phrases, lambda p: p.isNotNull()), 1, 5)
    out = chunks.where(F.col("name").isNotNull()).select(F.col("id").alias("chunk_id"), F.posexplode(kept).alias("n", "hint_text"))
    return out


def relational_hints(entities: DataFrame, deps: DataFrame, most: int = 6) -> DataFrame:
    """entity_id, n, hint_text, hint_type: phrases about an entity's open dependencies, outgoing first, at most six."""
    own = entities.where(F.col("entity_type").isin(*HINT_ENTITIES)).select("id", "name")
    names = entities.select("id", "name")
    edges = current(deps).select("source_entity", "target_entity", dep_type(F.col("dep_type")).alias("t")).distinct()
    x, y = own.select(F.col("id").alias("source_entity"), F.col("name").alias("x")), names.select(F.col("id").alias("target_entity"), F.col("name").alias("y"))
    out = edges.where(F.col("t").isin(*OUTGOING)).join(x, "source_entity").join(y, "target_entity")
    out = out.select(F.col("source_entity").alias("entity_id"), F.lit(0).alias("way"), F.concat_ws(" ", "x", "t", "y").alias("hint_text"), scalar._lookup(OUTGOING, F.col("t")).alias("hint_type"))
    into = edges.where(F.col("t").isin(*INCOMING)).join(own.select(F.col("id").alias("target_entity"), F.col("name").alias("x")), "target_entity")
    before, after, kind = (scalar._lookup({k: v[i] for k, v in INCOMING.items()}, F.col("t")) for i in range(3))
    into = into.select(F.col("target_entity").alias("entity_id"), F.lit(1).alias("way"), F.concat(before, F.col("x"), after).alias("hint_text"), kind.alias("hint_type")).distinct()
    w = Window.partitionBy("entity_id").orderBy("way", "hint_text")
    return out.unionByName(into).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("entity_id", "n", "hint_text", "hint_type")


#: Words that begin a sentence or are no names, for memory hints.
_NO_NAMES = "The This That These Those They There Then When Where What Which While With Without From Into About After Before And But For Not You Your Our His Her Its She Has Had Have Was Were Are Session Reminder Note Also".split()
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday"


def memory_hints(content: Column, most: int = 8) -> Column:
    """At most eight hints of a memory text: names, quoted strings, dates and what follows `about`, `named` or `called`."""
    names = F.array_except(F.regexp_extract_all(content, F.lit(r"\b([A-Z][a-z]{2,})\b"), 1), F.array(*[F.lit(w) for w in _NO_NAMES]))
    pairs = F.regexp_extract_all(content, F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"), 1)
    quoted = F.regexp_extract_all(content, F.lit("[\"“]([^\"“”]{3,50})[\"”]"), 1)
    dates = F.transform(F.regexp_extract_all(F.lower(content), F.lit(rf"\b({_MONTHS})\b"), 1), F.initcap)
    topics = F.regexp_extract_all(content, F.lit(r"\b(?:about|named|called) ((?:\w+ ?){1,4})"), 1)
    return F.slice(F.array_distinct(F.transform(F.concat(pairs, quoted, names, dates, topics), F.trim)), 1, most)


def directory_communities(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """path, depth, chunk_count, entity_count of every path prefix of a file, the file itself included."""
    def prefixes(path: Column) -> Column:
        parts = F.split(path, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))

    a = chunks.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count("*").alias("n"))
    a = a.select(F.explode(prefixes(F.col("file_path"))).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("chunk_count"))
    b = entities.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count("*").alias("n"))
    b = b.select(F.explode(prefixes(F.col("file_path"))).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("entity_count"))
    out = a.join(b, "path", "full_outer")
    return out.select("path", F.size(F.split("path", "/")).alias("depth"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


def community_texts(chunks: DataFrame, most: int = 8, least: float = 0.5) -> DataFrame:
    """path, chunk_count, text of every path prefix of a file: the path, and the summary of its chunks of importance `least` or more, in lower case.

    A summary names the folder, counts chunks by type and lists the `most` key items.
    """
    parts = F.split("file_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = chunks.where(F.col("file_path") != "").select(F.explode(prefixes).alias("path"), "id", "name", "chunk_type", "importance")
    own = (F.col("importance") >= least).cast("int")
    by_type = rows.groupBy("path", "chunk_type").agg(F.count("*").alias("all"), F.sum(own).alias("n"))
    count = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("m"), "chunk_type"))))
    count = by_type.groupBy("path").agg(F.sum("all").alias("chunk_count"), count.alias("kinds"))
    keys = top(rows.where((F.col("importance") >= least) & F.col("chunk_type").isin(*KEY_ITEMS)), most, F.desc("importance"), F.col("id"), by="path")
    keys = keys.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("name", F.lit("(unnamed)")).alias("name")))).alias("items"))
    kinds = F.array_join(F.transform("kinds", lambda x: F.concat((-x["m"]).cast("string"), F.lit(" "), x["chunk_type"])), ", ")
    items = F.concat(F.lit(". Key items: "), F.array_join(F.transform("items", lambda x: x["name"]), ", "))
    head = F.concat(F.lit("\n**"), F.element_at(F.split("path", "/"), -1), F.lit("** — "))
    summary = F.when(F.size("kinds") > 0, F.concat(head, kinds, F.coalesce(items, F.lit("")))).otherwise("")
    return count.join(keys, "path", "left").select("path", "chunk_count", F.lower(F.concat("path", summary)).alias("text"))


def matching_communities(texts: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
    """query_id, path: the `most` largest communities (path, chunk_count, text) whose text contains the whole query."""
    words = queries.select(F.lower("text").alias("asked")).dropna().distinct()
    # a text that contains a query holds its first letters: an equal join finds the few to look at
    size = F.length("asked")
    key = words.withColumn("gram", F.substring("asked", F.lit(1), F.when(size >= 6, 6).when(size >= 3, 3).otherwise(size)))
    starts = F.sequence(F.lit(1), F.length("text"))

    def every(n: int) -> Column:
        return F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(n)))

    places = texts.select("path", "chunk_count", "text", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), every(1), every(2), every(3), every(6)))).alias("gram"))
    fit = places.join(key, "gram").where(F.contains("text", F.col("asked"))).select("asked", "path", "chunk_count")
    best = top(fit, most, F.desc("chunk_count"), F.col("path"), by="asked").select("asked", "path")
    return queries.select("query_id", F.lower("text").alias("asked")).join(best, "asked").select("query_id", "path")


def community_chunks(chunks: DataFrame, paths: DataFrame, keep: int, key: Column) -> DataFrame:
    """path, id, importance of the chunks in or under each path, by an equal join on the prefixes of file paths.

    Of each path, the `keep` sources (`key`) with the most important chunks and
    of each source its `keep` most important chunks.
    """
    parts = F.split("file_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = chunks.where(F.col("file_path") != "").withColumn("source", F.coalesce(key, F.lit(""))).select("id", "importance", "source", F.explode(prefixes).alias("path"))
    rows = rows.join(paths.select("path").distinct(), "path", "left_semi").withColumn("group", F.struct("path", "source"))
    rows = top(rows, keep, F.desc("importance"), F.col("id"), by="group").withColumnRenamed("place", "within")
    first = top(rows.where("within = 1"), keep, F.desc("importance"), F.col("id"), by="path").select("group")
    return rows.join(first, "group", "left_semi").select("path", "id", "importance")


def module_communities(edges: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    """path, imports: the folders whose files have the most cross-file imports, by distinct pairs of files."""
    place = chunks.select("id", "file_path")
    pairs = edges.where(F.col("rel_type") == "imports").join(place.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(place.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst").where("a <> b").select("a", "b").distinct()
    folder = F.regexp_replace("a", "/[^/]*$", "")
    return pairs.groupBy(folder.alias("path")).agg(F.count("*").alias("imports")).orderBy(F.desc("imports"), "path").limit(most)


def type_hierarchies(entities: DataFrame, deps: DataFrame, most: int = 10, least: int = 2) -> DataFrame:
    """entity_id, name, children: the entities with the most distinct heirs, two at least."""
    edges = current(deps).select("source_entity", "target_entity", dep_type(F.col("dep_type")).alias("t")).where(F.col("t").isin("extends", "implements")).distinct()
    count = edges.groupBy(F.col("target_entity").alias("entity_id")).agg(F.count("*").alias("children"))
    named = count.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return named.orderBy(F.desc("children"), "entity_id").limit(most).where(F.col("children") >= least).select("entity_id", F.concat("name", F.lit(" hierarchy")).alias("name"), "children")


def episodes(events: DataFrame) -> DataFrame:
    """Events as provenance episodes: kinds of change per user and day."""
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return events.select("event_id", F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file_path"), kind.alias("change_type"), "ts", F.get_json_object("props", "$.k").cast("long").alias("chunks_affected"))


def add_attributes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Attributes of `old` and those of `new` whose (entity_id, kind, content) is not there; of equal new ones the smallest id."""
    key = ["entity_id", "kind", "content"]
    others = [c for c in new.columns if c not in key]
    one = new.dropna(subset=key).groupBy(*key).agg(F.min_by(F.struct(*others), "id").alias("x")).select(*key, "x.*")
    return old.unionByName(one.join(old.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def add_hints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hints (chunk_id, hint_text, hint_type) of both; a text that a chunk has already is not added again, a plain one has the type `plain`."""
    typed = new.withColumn("hint_type", F.coalesce("hint_type", F.lit("plain"))).dropna(subset=["chunk_id", "hint_text"])
    one = typed.groupBy("chunk_id", "hint_text").agg(F.min("hint_type").alias("hint_type"))
    return old.unionByName(one.join(old.select("chunk_id", "hint_text").distinct(), ["chunk_id", "hint_text"], "left_anti"))


def listed(entities: DataFrame, most: int = 50) -> DataFrame:
    """The most mentioned entities of each type, with their place; ties by id."""
    w = Window.partitionBy("entity_type").orderBy(F.desc("mentions"), "id")
    return entities.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def cards(entities: DataFrame, attributes: DataFrame, deps: DataFrame) -> DataFrame:
    """id, canonical_name, attributes (kind=count, joined), outgoing, incoming: what is known of each entity now."""
    kinds = attributes.groupBy(F.col("entity_id").alias("id"), "kind").agg(F.count("*").alias("n"))
    said = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",")
    now = current(deps).select("source_entity", "target_entity", dep_type(F.col("dep_type")).alias("k")).distinct()
    out = now.groupBy(F.col("source_entity").alias("id")).agg(F.count("*").alias("outgoing"))
    into = now.groupBy(F.col("target_entity").alias("id")).agg(F.count("*").alias("incoming"))
    each = entities.select("id", "canonical_name").join(kinds.groupBy("id").agg(said.alias("attributes")), "id", "left").join(out, "id", "left").join(into, "id", "left")
    return each.select("id", "canonical_name", F.coalesce("attributes", F.lit("")).alias("attributes"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("outgoing", "incoming")])


def seed_communities(communities: DataFrame, seeds: DataFrame, most: int = 10) -> DataFrame:
    """query_id, path: communities (path, depth) that are a seed's file (query_id, file_path) or a folder above it, the highest first."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = seeds.select("query_id", F.explode(above).alias("path")).distinct().join(communities.select("path", "depth").distinct(), "path")
    w = Window.partitionBy("query_id").orderBy("depth", "path")
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "path", "place")
