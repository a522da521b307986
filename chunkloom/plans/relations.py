"""Queries of relations, vectors, listings, rendering and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.common import Scratch, table
from chunkloom.functions import embed, scalar, stem
from chunkloom.operators import catalogue, entities, fulltext, graph, hierarchy, ranking, relations
from chunkloom.operators.chunks import live
from chunkloom.plans import sql as S
from chunkloom.plans.graph import _HINTS

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark, sf_dir, *names):
    return [live(table(spark, sf_dir, n)) if n == "chunks" else table(spark, sf_dir, n).distinct() for n in names]


def imports_parsed(spark, sf_dir):
    found = relations.imports(_t(spark, sf_dir, "chunks")[0].where("source_type = 'code'"))
    return found.select("id", "module", F.array_join("names", ",").alias("names"))


def import_edges(spark, sf_dir):
    return relations.import_edges(_t(spark, sf_dir, "chunks")[0].where("source_type = 'code'"))


def structural_relations(spark, sf_dir):
    return relations.structural(_t(spark, sf_dir, "chunks")[0].where("source_type = 'code'"))


def structural_deps(spark, sf_dir):
    chunks, ents = _t(spark, sf_dir, "chunks", "entities")
    return relations.structural_deps(relations.structural(chunks.where("source_type = 'code'")), ents)


def transitive_file_deps(spark, sf_dir):
    """Files that every file depends on within 3 hops of imports and calls."""
    chunks, ents, deps = _t(spark, sf_dir, "chunks", "entities", "entity_dependencies")
    edges = graph.materialise(deps, ents).where(F.col("rel_type").isin("imports", "calls"))
    return relations.transitive_files(edges, chunks, 3)


def attribute_add(spark, sf_dir):
    """Attributes of the entities of even id, and those of all added where they are not there."""
    (rows,) = _t(spark, sf_dir, "entity_attributes")
    out = entities.add_attributes(rows.where("entity_id % 2 = 0"), rows)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def hints_added(spark, sf_dir):
    """Hints of all chunks, added to those of every second one: no text twice for a chunk."""
    h = entities.template_hints(_t(spark, sf_dir, "chunks")[0]).select("chunk_id", "hint_text", F.lit(None).cast("string").alias("hint_type"))
    old = h.where("chunk_id % 2 = 0").select("chunk_id", "hint_text", F.lit("symbol").alias("hint_type"))
    return entities.add_hints(old, h).groupBy("hint_type").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))


def entity_list(spark, sf_dir):
    """The 20 most mentioned entities of each type; the limit is the report's."""
    return entities.listed(_t(spark, sf_dir, "entities")[0], 20).select("entity_type", "place", "id", "canonical_name", "mentions")


def entity_cards(spark, sf_dir):
    ents, attributes, deps = _t(spark, sf_dir, "entities", "entity_attributes", "entity_dependencies")
    return entities.cards(ents, attributes, deps)


def graph_boost_ids(spark, sf_dir):
    chunks, ents, attributes, deps = _t(spark, sf_dir, "chunks", "entities", "entity_attributes", "entity_dependencies")
    named = chunks.where((F.col("id") % 20 == 0) & F.col("name").isNotNull())
    return graph.boost_ids(ents, deps, attributes, named.select(F.col("id").alias("query_id"), scalar.name_words(F.col("name")).alias("text")))


def seed_communities(spark, sf_dir):
    """Folders and files above every twentieth chunk."""
    (chunks,) = _t(spark, sf_dir, "chunks")
    paths = catalogue.tree(chunks.select(F.col("file_path").alias("path"))).select("path", "depth")
    return entities.seed_communities(paths, chunks.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "file_path"))


def gravity(spark, sf_dir):
    out = ranking.gravity(table(spark, sf_dir, "search_results").distinct(), 0.8)
    return out.select("query_id", "chunk_id", F.round(F.col("score") + 1e-9, 6).alias("score"))


def layers_hit(spark, sf_dir):
    """How many results the text and the vector layer brought in, alone or together."""
    r = table(spark, sf_dir, "search_results").distinct()
    hit = F.array_compact(F.array(F.when(F.col("fts_rank").isNotNull(), "fts"), F.when(F.col("vec_distance").isNotNull(), "vector")))
    return ranking.layers_hit(r.withColumn("layers", hit))


def project_stats(spark, sf_dir):
    """Chunks, files and languages of each project (first folder)."""
    (chunks,) = _t(spark, sf_dir, "chunks")
    return chunks.groupBy(F.split("file_path", "/")[0].alias("project")).agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), F.count_distinct("language").alias("languages"))


def random_sample(spark, sf_dir):
    """200 chunks drawn at random, the same ones for the same seed; the draw is the feature."""
    (chunks,) = _t(spark, sf_dir, "chunks")
    return catalogue.drawn(chunks, 200, seed=7).select("id", "file_path")


def eval_queries(spark, sf_dir):
    """Evaluation queries as JSON would hold them."""
    (chunks,) = _t(spark, sf_dir, "chunks")
    return catalogue.eval_queries(chunks.where("id % 20 = 0"))


def context_rendered(spark, sf_dir):
    """The best five results of each query as one Markdown text, in their order."""
    chunks, found = _t(spark, sf_dir, "chunks", "search_results")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = found.select("query_id", "chunk_id", "score").withColumn("place", F.row_number().over(w)).where("place <= 5")
    out = catalogue.rendered(best.select("query_id", F.col("chunk_id").alias("id"), "place"), chunks)
    return out.select("query_id", "chunks", F.sha2("text", 256).alias("digest"))


def vector_codec(spark, sf_dir):
    """Vectors to bytes and back."""
    v = table(spark, sf_dir, "chunks_vec").where(F.col("embedding").isNotNull()).select("chunk_id", "embedding").distinct()
    raw = v.withColumn("raw", embed.packed("embedding"))
    return raw.select("chunk_id", F.octet_length("raw").alias("bytes"), (embed.unpacked("raw") == F.col("embedding")).alias("same"))


def vectors_stored(spark, sf_dir):
    """Vectors of all chunks stored over those of every second one."""
    v = table(spark, sf_dir, "chunks_vec").distinct()
    return embed.stored(v.where("chunk_id % 2 = 0"), v).select("chunk_id", F.unix_micros("created_at").alias("created_at"))


def embed_unembedded(spark, sf_dir):
    """Live chunks without a vector, embedded by the offline provider."""
    chunks, vectors = _t(spark, sf_dir, "chunks", "chunks_vec")
    made = embed.embedded(embed.unembedded(chunks, vectors).where(F.trim("content_raw") != ""), "content_raw", embed.HashedGrams(64))
    return made.select("id", F.size("embedding").alias("dimensions"), F.round(embed.length(F.col("embedding")), 3).alias("length"))


def hint_vector_knn(spark, sf_dir):
    """Chunks whose hints lie nearest to the names of every twentieth chunk, by vectors of the offline provider."""
    (chunks,) = _t(spark, sf_dir, "chunks")
    provider = embed.HashedGrams(64)
    scratch = Scratch(spark, "hints")
    hints = scratch.cut(entities.template_hints(chunks).select("chunk_id", "hint_text").distinct().withColumn("id", F.xxhash64("chunk_id", "hint_text")))
    named = chunks.where((F.col("id") % 20 == 0) & F.col("name").isNotNull()).select(F.col("id").alias("query_id"), F.concat(F.lit("function "), "name").alias("text"))
    named = scratch.cut(named.withColumn("asks", F.min("query_id").over(Window.partitionBy("text"))))
    # equal texts have one vector: it is made and compared once, and of the hints that share it the k smallest ids can be among the nearest k
    same = scratch.cut(fulltext.top(hints, 20, F.col("id"), by="hint_text").withColumn("first", F.min("id").over(Window.partitionBy("hint_text"))))
    texts = embed.embedded(same.where("id = first").select("id", "hint_text"), "hint_text", provider, "v")
    asks = embed.embedded(named.where("query_id = asks").select(F.col("query_id").alias("id"), "text"), "text", provider, "v")
    near = ranking.nearest(texts.select("id", "v"), asks.select("id", "v"), 20, "cosine").withColumnRenamed("id", "first")
    near = fulltext.top(near.join(same.select("first", "id", "chunk_id"), "first"), 20, F.round("distance", 9), F.col("id"))
    each = near.groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.round(F.min("distance"), 4).alias("distance"))
    return fulltext.answered(named, each)


def stems(spark, sf_dir):
    """Stems of the words of the documents, with their words and places; each distinct word is stemmed once."""
    words = table(spark, sf_dir, "documents").select(F.explode(scalar.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy(stem.stemmed("word").alias("stem")).agg(F.count("*").alias("words"), F.sum("n").alias("n"))


def p6_other_parents(spark, sf_dir):
    return hierarchy.other_parents(hierarchy.open_edges(table(spark, sf_dir, "entity_dependencies")))


def p6_descendants(spark, sf_dir):
    """All descendants of every entity on an open `contains` edge."""
    tree = hierarchy.nested_sets(hierarchy.open_edges(table(spark, sf_dir, "entity_dependencies")))
    return hierarchy.descendants(tree, tree.select(F.col("node").alias("ancestor")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (imports_parsed, import_edges, structural_relations, structural_deps, transitive_file_deps, attribute_add, hints_added, entity_list, entity_cards, graph_boost_ids, seed_communities, gravity, layers_hit, project_stats, random_sample, eval_queries, context_rendered, vector_codec, vectors_stored, embed_unembedded, hint_vector_knn, stems, p6_other_parents, p6_descendants)
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _import_form(pattern: str, module: int, named: int) -> str:
    p = _quoted(pattern)
    names = "''"
    if named:
        each = f"list_transform(string_split(x[2], ','), lambda n: trim(regexp_replace(regexp_replace(n, '\\s+as\\s+\\w+', ''), '^\\s*type\\s+', '')))"
        names = f"array_to_string(list_filter({each}, lambda n: regexp_matches(n, '^\\w+$')), ',')"
    pair = f"list_transform(list_zip(regexp_extract_all(content_raw, {p}, {module}), regexp_extract_all(content_raw, {p}, {named or module})), lambda x: {{'module': x[1], 'names': {names}}})"
    return f"select id, unnest({pair}, recursive := true) from code"


def _heir_form(pattern: str, heir: int, parents: int, kind: str) -> str:
    p = _quoted(pattern)
    return f"select id, unnest(regexp_extract_all(content_raw, {p}, {heir})) as heir, unnest(regexp_extract_all(content_raw, {p}, {parents})) as parents, '{kind}' as rel_type from heirs"


_CODE = "code as (select * from live where source_type = 'code')"
_HEIRS = "heirs as (select * from live where source_type = 'code' and chunk_type in ('class', 'struct', 'interface', 'trait', 'impl', 'enum', 'section'))"
_PAIRS = "pairs as (" + " union all ".join(_heir_form(*h) for h in relations._HEIRS) + ")"
_SPLIT = "split as (select id, heir, rel_type, unnest(string_split(regexp_replace(parents, '<[^>]*>', '', 'g'), ',')) as p from pairs)"
_STATED = r"stated as (select distinct id, heir, regexp_extract(p, '(\w+)[ \t]*$', 1) as parent, rel_type from split where regexp_extract(p, '(\w+)[ \t]*$', 1) not in ('', 'object', 'Object') and not contains(p, '='))"
_SR = "sr as (select distinct * from search_results)"
_ATTR = "attr as (select distinct * from entity_attributes)"
_RENDERED = "'### ' || coalesce(name, chunk_type) || chr(10) || '**File:** `' || file_path || '` **Lines:** ' || (line_start + 1) || '-' || (line_end + 1) || ' **Type:** ' || chunk_type || chr(10) || chr(10) || '```' || coalesce(language, '') || chr(10) || coalesce(content_raw, '') || chr(10) || '```' || chr(10)"
_OPEN = "(valid_to is null or valid_to::date = date '9999-12-31')"

SQL: dict[str, str] = {
    "imports_parsed": S.with_(S.LATEST, _CODE) + "select distinct id, module, names from (" + " union all ".join(_import_form(*f) for f in relations._FORMS) + ")",
    "structural_relations": S.with_(S.LATEST, _HEIRS, _PAIRS, _SPLIT, _STATED) + "select * from stated",
    "structural_deps": S.with_(S.LATEST, _HEIRS, _PAIRS, _SPLIT, _STATED) + "select distinct a.id as source_entity, b.id as target_entity, rel_type as dep_type from stated s join entities a on a.canonical_name = lower(s.heir) join entities b on b.canonical_name = lower(s.parent) where a.id <> b.id",
    "transitive_file_deps": S.with_(S.LATEST, S.EDGES, S.ENTITIES, S.RELATIONS, "step as (select distinct a.file_path as src, b.file_path as dst from rels r join live a on a.id = r.src join live b on b.id = r.dst where a.file_path <> b.file_path and r.rel_type in ('imports', 'calls'))", "one as (select src as source, dst as target, 1 as depth from step)", "two as (select source, dst as target, 2 as depth from one join step on target = src)", "three as (select source, dst as target, 3 as depth from two join step on target = src)")
    + "select source, target, min(depth)::int as depth from (select * from one union select * from two union select * from three) where source <> target group by 1, 2",
    "attribute_add": S.with_(_ATTR, "old as (select * from attr where entity_id % 2 = 0)", "new as (select entity_id, kind, content, min(id) as id from attr where entity_id is not null and kind is not null and content is not null group by 1, 2, 3)", "both_ as (select id, kind from old union all select id, kind from new n where not exists (select 1 from old o where o.entity_id = n.entity_id and o.kind = n.kind and o.content = n.content))") + "select kind, count(*) as n, min(id) as first from both_ group by 1",
    "hints_added": S.with_(S.LATEST, _HINTS) + "select 'symbol' as hint_type, count(*) as n, count(distinct chunk_id) as chunks from hints where chunk_id % 2 = 0 union all select 'plain', count(*), count(distinct chunk_id) from (select distinct chunk_id, hint_text from hints where chunk_id % 2 <> 0)",
    "entity_list": S.with_(S.ENTITIES, "p as (select *, row_number() over (partition by entity_type order by mentions desc, id) as place from ents)") + "select entity_type, place, id, canonical_name, mentions from p where place <= 20",
    "entity_cards": S.with_(S.ENTITIES, _ATTR, S.EDGES, "k as (select entity_id as id, kind || '=' || count(*) as said from attr group by entity_id, kind)", "a as (select id, string_agg(said, ',' order by said) as attributes from k group by 1)", "o as (select src as id, count(*) as n from edges group by 1)", "i as (select dst as id, count(*) as n from edges group by 1)")
    + "select e.id, canonical_name, coalesce(attributes, '') as attributes, coalesce(o.n, 0) as outgoing, coalesce(i.n, 0) as incoming from ents e left join a using (id) left join o using (id) left join i using (id)",
    "graph_boost_ids": S.with_(S.LATEST, S.QUERIES, S.ENTITIES, _ATTR, f"tok as (select distinct query_id, unnest(list_filter({S.tokens('text')}, lambda t: strlen(t) >= 2)) as token from queries)", "w as (select distinct token from tok)", "m as (select token, id, mentions from (select token, id, mentions, row_number() over (partition by token order by mentions desc, id) n from w join ents on contains(canonical_name, token)) where n <= 100)", "q0 as (select distinct query_id, id, mentions from tok join m using (token))", "q1 as (select * from (select *, row_number() over (partition by query_id order by id) n from q0) where n <= 100)", "q2 as (select * from (select *, row_number() over (partition by query_id order by mentions desc, id) n2 from q1) where n2 <= 100)", "q3 as (select query_id, id from (select *, row_number() over (partition by query_id order by id) n3 from q2) where n3 <= 20)", "u as (select source_entity as s, target_entity as t from entity_dependencies union select target_entity, source_entity from entity_dependencies)", "x as (select query_id, id from q3 union select query_id, t from q3 join u on s = id where t is not null)", "c as (select distinct query_id, chunk_id as id from x join attr on entity_id = x.id where chunk_id is not null)")
    + "select query_id, id from (select *, row_number() over (partition by query_id order by id) n from c) where n <= 50",
    "seed_communities": S.with_(S.LATEST, "p as (select distinct array_to_string(parts[1:i], '/') as path, i - 1 as depth from (select string_split(file_path, '/') as parts from live), unnest(range(1, len(parts) + 1)) as t(i))", "s as (select distinct id as query_id, array_to_string(parts[1:i], '/') as path from (select id, string_split(file_path, '/') as parts from live where id % 20 = 0), unnest(range(1, len(parts) + 1)) as t(i))", "r as (select query_id, path, row_number() over (partition by query_id order by depth, path) as place from s join p using (path))") + "select query_id, path, place from r where place <= 10",
    "gravity": S.with_(_SR) + "select query_id, chunk_id, round(avg(score) over w + (score - avg(score) over w) * 0.8 + 1e-9, 6) as score from sr window w as (partition by query_id)",
    "layers_hit": S.with_(_SR) + "select 'fts' as layer, count(fts_rank) as n from sr union all select 'vector', count(vec_distance) from sr",
    "project_stats": S.with_(S.LATEST) + "select string_split(file_path, '/')[1] as project, count(*) as chunks, count(distinct file_path) as files, count(distinct language) as languages from live group by 1",
    "random_sample": S.with_(S.LATEST) + "select id, file_path from live order by md5(id || ':7'), id limit 200",
    "eval_queries": S.with_(S.LATEST) + "select trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as eval_query, id as chunk_id, file_path, name, chunk_type, substr(content_raw, 1, 120) as content_preview, coalesce(language, 'unknown') as language from live where id % 20 = 0 and chunk_type in ('function', 'method', 'class', 'interface') and source_type = 'code' and length(name) > 3",
    "context_rendered": S.with_(S.LATEST, _SR, "b as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as place from (select query_id, chunk_id, score from sr))", f"r as (select query_id, place, {_RENDERED} as said from b join live on live.id = chunk_id where place <= 5)") + "select query_id, count(*) as chunks, sha256(string_agg(said, chr(10) order by place)) as digest from r group by 1",
    "vector_codec": "select distinct chunk_id, (4 * len(embedding))::int as bytes, true as same from (select distinct chunk_id, embedding from chunks_vec where embedding is not null)",
    "vectors_stored": "select chunk_id, max(epoch_us(created_at)) as created_at from chunks_vec group by 1",
    "embed_unembedded": S.with_(S.LATEST) + "select id, 64 as dimensions, 1.0::double as length from live where trim(content_raw) <> '' and id not in (select chunk_id from chunks_vec where len(embedding) > 0)",
    "p6_other_parents": f"with e as (select distinct target_entity as node, source_entity as parent from entity_dependencies where lower(trim(dep_type)) = 'contains' and {_OPEN} and source_entity is not null and target_entity is not null), m as (select node, min(parent) as kept, count(*) as parents from e group by 1 having count(*) > 1) select e.node, e.parent, m.kept, m.parents from e join m using (node) where e.parent <> m.kept",
    "p6_descendants": f"with recursive e as (select target_entity as node, min(source_entity) as parent from entity_dependencies where lower(trim(dep_type)) = 'contains' and {_OPEN} and source_entity is not null and target_entity is not null group by 1), r as (select distinct parent as node from e where parent not in (select node from e)), d as (select node, [node] as path from r union all select e.node, list_append(d.path, e.node) from d join e on e.parent = d.node) select unnest(path[:-2]) as ancestor, node from d where len(path) > 1",
}
