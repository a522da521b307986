"""Queries over the entity graph: hierarchies, orphans, temporal facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.common import table
from chunkloom.functions import scalar
from chunkloom.operators import entities, graph, hierarchy, orphans
from chunkloom.operators.chunks import live
from chunkloom.plans import sql as S

Query = Callable[[SparkSession, str], DataFrame]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("chunks", "files", "entities", "entity_attributes", "entity_dependencies")
    return orphans.standard(*[table(spark, sf_dir, n) for n in names])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_field", "ref_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.report(_orphans(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.found(table(spark, sf_dir, "entity_dependencies"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy.nested_sets(hierarchy.open_edges(table(spark, sf_dir, "entity_dependencies")), with_path=True)
    path = F.array_join(F.col("path").cast("array<string>"), "/")
    return tree.select(F.col("node").alias("entity_id"), path.alias("path"), "depth", F.col("root").alias("root_entity"), (F.col("size") - 1).alias("descendants"))


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n).distinct() if n != "chunks" else live(table(spark, sf_dir, n)) for n in names]


def _relations(spark, sf_dir):
    deps, ents = _t(spark, sf_dir, "entity_dependencies", "entities")
    return graph.materialise(deps, ents)


def materialised_edges(spark, sf_dir):
    return _relations(spark, sf_dir)


def _seeds(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") % 20 == 0).select(F.col("src").alias("node")).distinct()


def graph_closure_depth(spark, sf_dir):
    """Chunks that every twentieth chunk depends on, by imports and calls, within 3 hops."""
    edges = _relations(spark, sf_dir).where(F.col("rel_type").isin("imports", "calls"))
    return graph.reached(edges, _seeds(edges), 3)


def graph_dependents(spark, sf_dir):
    edges = graph.reverse(_relations(spark, sf_dir).where(F.col("rel_type").isin("imports", "calls")))
    return graph.reached(edges, _seeds(edges), 3)


def entity_closure(spark, sf_dir):
    (deps,) = _t(spark, sf_dir, "entity_dependencies")
    edges = graph.entity_edges(deps).where(F.col("rel_type") != "contains")
    return graph.reached(edges, _seeds(edges), 2)


def graph_neighbourhood(spark, sf_dir):
    """The undirected neighbourhood of every hundredth entity within 2 hops: nodes by distance."""
    (deps,) = _t(spark, sf_dir, "entity_dependencies")
    edges = graph.undirected(graph.entity_edges(deps))
    seeds = edges.where(F.col("src") % 100 == 0).select(F.col("src").alias("node")).distinct()
    return graph.reached(edges, seeds, 2).groupBy("origin", "depth").agg(F.count("*").alias("nodes"))


def entity_closure_all(spark, sf_dir):
    """As `entity_closure`, along open edges of every type."""
    (deps,) = _t(spark, sf_dir, "entity_dependencies")
    edges = graph.entity_edges(deps)
    return graph.reached(edges, _seeds(edges), 2)


def graph_neighbourhood_all(spark, sf_dir):
    """As `graph_neighbourhood`, of every twentieth entity."""
    (deps,) = _t(spark, sf_dir, "entity_dependencies")
    edges = graph.undirected(graph.entity_edges(deps))
    return graph.reached(edges, _seeds(edges), 2).groupBy("origin", "depth").agg(F.count("*").alias("nodes"))


def file_dependencies(spark, sf_dir):
    """Distinct pairs of files between which an edge runs, with the number of edges."""
    (chunks,) = _t(spark, sf_dir, "chunks")
    place = chunks.select("id", "file_path")
    e = _relations(spark, sf_dir).join(place.select(F.col("id").alias("src"), F.col("file_path").alias("source")), "src").join(place.select(F.col("id").alias("dst"), F.col("file_path").alias("target")), "dst")
    return e.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("edges"))


def structural_importance(spark, sf_dir):
    chunks, attributes = _t(spark, sf_dir, "chunks", "entity_attributes")
    bound = attributes.where((F.col("kind") == "constraint") & F.col("chunk_id").isNotNull()).select(F.col("chunk_id").alias("id"))
    return graph.importance(chunks, _relations(spark, sf_dir), bound).select("id", F.round("importance", 6).alias("importance"))


def contains_lookup(spark, sf_dir):
    return graph.contains_edges(_t(spark, sf_dir, "chunks")[0])


def override_edges(spark, sf_dir):
    deps, ents = _t(spark, sf_dir, "entity_dependencies", "entities")
    return graph.overrides(deps, ents)


def _text_queries(spark, sf_dir):
    rows = _t(spark, sf_dir, "chunks")[0]
    named = rows.where((F.col("id") % 20 == 0) & F.col("name").isNotNull())
    return named.select(F.col("id").alias("query_id"), scalar.name_words(F.col("name")).alias("text"))


def seed_entities(spark, sf_dir):
    return graph.seed_entities(_t(spark, sf_dir, "entities")[0], _text_queries(spark, sf_dir)).select("query_id", F.col("node").alias("entity_id"))


def graph_boost_scored(spark, sf_dir):
    deps, ents, attributes = _t(spark, sf_dir, "entity_dependencies", "entities", "entity_attributes")
    return graph.graph_boost(ents, deps, attributes, _text_queries(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"))


def context_expand(spark, sf_dir):
    """Chunks to show beside every twentieth chunk."""
    chunks, ents, deps = _t(spark, sf_dir, "chunks", "entities", "entity_dependencies")
    edges = _relations(spark, sf_dir)
    seeds = _seeds(edges).select(F.col("node").alias("query_id"), "node")
    return graph.context(edges, edges, seeds, chunks, depth=1, most=20).select("query_id", "id", "score")


def context_expand_full(spark, sf_dir):
    """As `context_expand`, two hops deep and up to 50 chunks, the operator's defaults."""
    chunks, ents, deps = _t(spark, sf_dir, "chunks", "entities", "entity_dependencies")
    edges = _relations(spark, sf_dir)
    seeds = _seeds(edges).select(F.col("node").alias("query_id"), "node")
    return graph.context(edges, edges, seeds, chunks).select("query_id", "id", "score")


def facts_at(spark, sf_dir):
    (deps,) = _t(spark, sf_dir, "entity_dependencies")
    held = entities.facts_at(deps, F.lit("2025-07-01 00:00:00").cast("timestamp"))
    return held.select("id", "source_entity", "target_entity", graph.dep_type(F.col("dep_type")).alias("dep_type"))


def fact_history(spark, sf_dir):
    (deps,) = _t(spark, sf_dir, "entity_dependencies")
    return entities.fact_history(deps).select("source_entity", "target_entity", "dep_type", "version", "versions", F.unix_micros("valid_from").alias("valid_from"))


def current_facts(spark, sf_dir):
    (deps,) = _t(spark, sf_dir, "entity_dependencies")
    return entities.current(deps).groupBy(graph.dep_type(F.col("dep_type")).alias("dep_type")).agg(F.count("*").alias("facts"), F.round(F.avg("strength"), 6).alias("strength"))


def supersede_facts(spark, sf_dir):
    """How many dependencies of each type are open after those of every tenth source were superseded."""
    (deps,) = _t(spark, sf_dir, "entity_dependencies")
    out = entities.supersede(deps, deps.where(F.col("source_entity") % 10 == 0), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return out.groupBy(graph.dep_type(F.col("dep_type")).alias("dep_type")).agg(F.count_if(graph.is_open(F.col("valid_to"))).alias("open"), F.count("*").alias("facts"))


def entity_upsert(spark, sf_dir):
    (chunks,) = _t(spark, sf_dir, "chunks")
    return entities.upsert(entities.symbols(chunks)).select("canonical_name", "mentions", "entity_type", "chunk_id")


def mention_counter(spark, sf_dir):
    ents, attributes = _t(spark, sf_dir, "entities", "entity_attributes")
    return entities.count_mentions(ents.select(F.col("id").alias("entity_id"), "mentions"), attributes, "entity_id")


def hints_template(spark, sf_dir):
    return entities.template_hints(_t(spark, sf_dir, "chunks")[0])


def hints_relational(spark, sf_dir):
    ents, deps = _t(spark, sf_dir, "entities", "entity_dependencies")
    return entities.relational_hints(ents, deps)


def hints_memory(spark, sf_dir):
    rows = _t(spark, sf_dir, "chunks")[0].where(F.col("source_type") == "memory")
    return rows.select("id", entities.memory_hints(F.col("content_raw")).alias("hints"))


def hints_concatenated(spark, sf_dir):
    """Each chunk's hints in one text."""
    h = entities.template_hints(_t(spark, sf_dir, "chunks")[0])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "hint_text"))), lambda x: x["hint_text"]), " ")
    return h.groupBy("chunk_id").agg(text.alias("hints"))


def hint_search(spark, sf_dir):
    from chunkloom.operators import search

    chunks, ents, deps = _t(spark, sf_dir, "chunks", "entities", "entity_dependencies")
    h = entities.template_hints(chunks).select("chunk_id", "hint_text", F.lit("symbol").alias("hint_type"))
    related = entities.relational_hints(ents, deps).join(ents.where(F.col("chunk_id").isNotNull()).select(F.col("id").alias("entity_id"), "chunk_id"), "entity_id")
    h = h.unionByName(related.select("chunk_id", "hint_text", "hint_type"))
    return search.hint_search(h, _text_queries(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"))


def directory_communities(spark, sf_dir):
    chunks, ents = _t(spark, sf_dir, "chunks", "entities")
    return entities.directory_communities(chunks, ents)


def module_communities(spark, sf_dir):
    return entities.module_communities(_relations(spark, sf_dir), _t(spark, sf_dir, "chunks")[0])


def type_hierarchy(spark, sf_dir):
    ents, deps = _t(spark, sf_dir, "entities", "entity_dependencies")
    return entities.type_hierarchies(ents, deps)


def community_search(spark, sf_dir):
    """Folders whose path contains `token`, the largest first."""
    chunks, ents = _t(spark, sf_dir, "chunks", "entities")
    c = entities.directory_communities(chunks, ents)
    return c.where(F.contains(F.lower("path"), F.lit("token"))).orderBy(F.desc("chunk_count"), "path").limit(20)


def community_members(spark, sf_dir):
    """The five most important chunks under each first folder, by an equal join on the path's prefix."""
    from chunkloom.operators.fulltext import top

    rows = _t(spark, sf_dir, "chunks")[0].withColumn("path", F.split("file_path", "/")[0])
    return top(rows, 5, F.desc("importance"), F.col("id"), by="path").select("path", "id", "place")


def community_summary(spark, sf_dir):
    """Per folder of the first level: counts by type in words, and the key items of importance 0.5 or more."""
    rows = _t(spark, sf_dir, "chunks")[0].withColumn("path", F.split("file_path", "/")[0])
    kinds = rows.groupBy("path", "chunk_type").agg(F.count("*").alias("n")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "chunk_type", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["chunk_type"])), ", ").alias("kinds"))
    from chunkloom.operators.fulltext import top

    keys = top(rows.where((F.col("importance") >= 0.5) & F.col("name").isNotNull()), 8, F.desc("importance"), F.col("id"), by="path")
    keys = keys.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias("keys"))
    return kinds.join(keys, "path", "left").select("path", "kinds", "keys")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p4_found, p4_report, p6_found, p6_paths, materialised_edges, graph_closure_depth, graph_dependents, entity_closure, entity_closure_all, graph_neighbourhood, graph_neighbourhood_all, file_dependencies, structural_importance, contains_lookup, override_edges, seed_entities, graph_boost_scored, context_expand, context_expand_full, facts_at, fact_history, current_facts, supersede_facts, entity_upsert, mention_counter, hints_template, hints_relational, hints_memory, hints_concatenated, hint_search, directory_communities, module_communities, type_hierarchy, community_search, community_members, community_summary)
}

_ORPHANS = r"""
with st as (select id, min(created_at) since, arg_max(is_deleted, (coalesce(updated_at, timestamp '0001-01-01'), is_deleted)) gone from chunks group by id),
fs as (select regexp_replace(regexp_replace(replace(trim(path),'\','/'),'/{2,}','/','g'),'^(\./)+','') p, min(indexed_at) since from files group by 1),
es as (select id, min(created_at) since from entities group by id),
c as (select distinct id, created_at, regexp_replace(regexp_replace(replace(trim(file_path),'\','/'),'/{2,}','/','g'),'^(\./)+','') p from chunks),
o as (
select distinct 'chunks' as ref_table, 'file_path' as ref_field, c.id as ref_id, c.created_at as made from c left join fs using (p) where c.p <> '' and (fs.since is null or fs.since > c.created_at)
union select distinct 'entity_attributes', 'chunk_id', a.id, a.created_at from entity_attributes a left join st on st.id = a.chunk_id where a.chunk_id is not null and a.chunk_id <> -1 and (st.since is null or st.gone or st.since > a.created_at)
union select distinct 'entity_dependencies', 'target_entity', d.id, d.created_at from entity_dependencies d left join es on es.id = d.target_entity where d.target_entity is not null and d.target_entity <> -1 and (es.since is null or es.since > d.created_at))
"""

_TREE = """
with recursive e as (select target_entity as child, min(source_entity) as parent from entity_dependencies
where lower(trim(dep_type)) = 'contains' and (valid_to is null or valid_to::date = date '9999-12-31') and source_entity is not null and target_entity is not null group by 1),
nodes as (select child as id from e union select parent from e),
t as (select id, id as root, 0 as depth, id::varchar as path from nodes where id not in (select child from e)
union all select e.child, t.root, t.depth + 1, t.path || '/' || e.child from t join e on e.parent = t.id)
"""



def _closure(edges: str, seeds: str, hops: int, most: str = "depth > 0") -> str:
    return f"""reach as (select distinct src as origin, src as node, 0 as depth from ({edges}) where {seeds}
union select r.origin, e.dst, r.depth + 1 from reach r join ({edges}) e on e.src = r.node where r.depth < {hops}),
near as (select origin, node, min(depth) as depth from reach group by origin, node)"""


_DEP_EDGES = "select distinct src, dst from rels where rel_type in ('imports', 'calls')"
_BACK_EDGES = "select distinct dst as src, src as dst from rels where rel_type in ('imports', 'calls')"
_DEPS = "deps as (select distinct * from entity_dependencies)"
_ATTR = "attr as (select distinct * from entity_attributes)"
_SEEDS = f"""tok as (select distinct query_id, unnest(list_filter({S.tokens('text')}, lambda t: strlen(t) >= 2)) as token from queries),
words as (select distinct token from tok),
matched as (select token, id from (select w.token, e.id, row_number() over (partition by w.token order by e.mentions desc, e.id) n from words w join ents e on contains(e.canonical_name, w.token)) where n <= 5),
seeds as (select query_id, node from (select query_id, node, row_number() over (partition by query_id order by node) n from (select distinct query_id, m.id as node from tok join matched m using (token))) where n <= 20)"""
_UNDIRECTED = "und as (select distinct src, dst from edges union select distinct dst, src from edges)"
_OPEN = "(valid_to is null or valid_to::date = date '9999-12-31')"
_FIRST = "string_split(content_raw, chr(10))[1]"
_HINTS = rf"""hints as (select id as chunk_id, unnest(range(0, len(h))) as n, unnest(h) as hint_text from (select id, list_filter([
'how does ' || nm || ' work', 'where is ' || nm || ' defined', nm || ' implementation',
case when chunk_type in ('function', 'method') then nm || ' function' when chunk_type in ('struct', 'class', 'interface') then nm || ' type definition' end,
case when chunk_type in ('function', 'method') then 'calling ' || nm || ' from' when chunk_type in ('struct', 'class', 'interface') then nm || ' methods' end,
case when len(w) >= 3 then array_to_string(w[1:6], ' ') end, 'code in ' || string_split(file_path, '/')[-1]], lambda p: p is not null)[1:5] as h
from (select *, trim(replace(name, '_', ' ')) as nm, list_filter(string_split_regex({_FIRST}, '\s+'), lambda x: x <> '') as w from live where name is not null)))"""
_COMMUNITIES = """cp as (select array_to_string(parts[1:i], '/') as path, count(*) as n from (select string_split(file_path, '/') as parts from live), unnest(range(1, len(parts) + 1)) as t(i) group by 1),
ep as (select array_to_string(parts[1:i], '/') as path, count(*) as n from (select string_split(file_path, '/') as parts from ents where file_path is not null), unnest(range(1, len(parts) + 1)) as t(i) group by 1),
comm as (select path, len(string_split(path, '/'))::int as depth, coalesce(cp.n, 0)::bigint as chunk_count, coalesce(ep.n, 0)::bigint as entity_count from cp full join ep using (path))"""
_REL_HINTS = """own as (select id, name from ents where entity_type in ('function', 'method', 'class', 'struct', 'interface', 'trait', 'enum')),
oh as (select e.src as entity_id, 0 as way, x.name || ' ' || e.rel_type || ' ' || y.name as hint_text, case when rel_type in ('implements', 'extends', 'overrides') then 'heir' when rel_type = 'contains' then 'member' when rel_type = 'imports' then 'importer' else 'callee' end as hint_type
from edges e join own x on x.id = e.src join ents y on y.id = e.dst where rel_type in ('implements', 'extends', 'overrides', 'contains', 'calls', 'references', 'imports')
union all select distinct e.dst, 1, case rel_type when 'implements' then 'implementations of ' || x.name when 'extends' then 'subclasses of ' || x.name when 'overrides' then 'methods overridden by ' || x.name when 'contains' then x.name || ' members'
when 'calls' then 'callers of ' || x.name when 'imports' then 'files that import ' || x.name else 'entities referencing ' || x.name end,
case when rel_type in ('implements', 'extends', 'overrides') then 'heir' when rel_type = 'contains' then 'member' when rel_type = 'imports' then 'importer' when rel_type = 'calls' then 'caller' else 'callee' end
from edges e join own x on x.id = e.dst where rel_type in ('implements', 'extends', 'overrides', 'contains', 'calls', 'references', 'imports'))"""

SQL: dict[str, str] = {
    "p4_found": _ORPHANS + "select ref_table, ref_field, ref_id from o",
    "p4_report": _ORPHANS + "select ref_table, ref_field, strftime(made, '%Y-%m') as month, count(*) as orphans from o group by all",
    "p6_found": _TREE + "select n.id as entity_id, coalesce(t.root, -1) as root_entity, coalesce(t.depth, -1)::bigint as depth from nodes n left join t on t.id = n.id",
    "p6_paths": _TREE + "select n.id as entity_id, t.path, coalesce(t.depth, -1) as depth, t.root as root_entity, case when t.id is not null then (select count(*) from t d where d.path like t.path || '/%') end as descendants from nodes n left join t on t.id = n.id",
    "materialised_edges": S.with_(S.EDGES, S.ENTITIES, S.RELATIONS) + "select * from rels",
    "graph_closure_depth": S.with_(S.EDGES, S.ENTITIES, S.RELATIONS, _closure(_DEP_EDGES, "src % 20 = 0", 3), recursive=True) + "select * from near where depth > 0",
    "graph_dependents": S.with_(S.EDGES, S.ENTITIES, S.RELATIONS, _closure(_BACK_EDGES, "src % 20 = 0", 3), recursive=True) + "select * from near where depth > 0",
    "entity_closure": S.with_(S.EDGES, _closure("select distinct src, dst from edges where rel_type <> 'contains'", "src % 20 = 0", 2), recursive=True) + "select * from near where depth > 0",
    "graph_neighbourhood": S.with_(S.EDGES, _UNDIRECTED, _closure("select src, dst from und", "src % 100 = 0", 2), recursive=True) + "select origin, depth, count(*) as nodes from near where depth > 0 group by 1, 2",
    "entity_closure_all": S.with_(S.EDGES, _closure("select distinct src, dst from edges", "src % 20 = 0", 2), recursive=True) + "select * from near where depth > 0",
    "graph_neighbourhood_all": S.with_(S.EDGES, _UNDIRECTED, _closure("select src, dst from und", "src % 20 = 0", 2), recursive=True) + "select origin, depth, count(*) as nodes from near where depth > 0 group by 1, 2",
    "file_dependencies": S.with_(S.LATEST, S.EDGES, S.ENTITIES, S.RELATIONS) + "select a.file_path as source, b.file_path as target, count(*) as edges from rels join live a on a.id = src join live b on b.id = dst where a.file_path <> b.file_path group by 1, 2",
    "structural_importance": S.with_(S.LATEST, S.EDGES, S.ENTITIES, S.RELATIONS, "i as (select dst as id, count(*) n from rels where rel_type in ('imports', 'calls') group by 1)", "h as (select src as id, count(*) n from rels where rel_type = 'contains' group by 1)", "b as (select distinct chunk_id as id from entity_attributes where kind = 'constraint' and chunk_id is not null)")
    + "select l.id, round(least(greatest(l.importance * (0.3 + 0.3 * log10(1 + coalesce(i.n, 0)) + 0.2 * log10(1 + coalesce(h.n, 0)) + case when b.id is not null then 0.2 else 0 end), 0.1), 1.0), 6) as importance from live l left join i using (id) left join h using (id) left join b using (id)",
    "contains_lookup": S.with_(S.LATEST, "b as (select *, last_value(case when chunk_type in ('class', 'impl', 'trait', 'module', 'enum', 'struct') then {'id': id, 'lo': line_start, 'hi': line_end} end ignore nulls) over (partition by file_path order by line_start, id rows between unbounded preceding and 1 preceding) as box from live)")
    + "select box.id as src, id as dst from b where chunk_type in ('method', 'constant', 'type') and line_start > box.lo and line_end <= box.hi",
    "override_edges": S.with_(S.EDGES, S.ENTITIES, r"m as (select id, regexp_replace(canonical_name, '#\d+$', '') as n from ents where entity_type = 'method')", "h as (select e.src as c, e.dst as m, m.n from edges e join m on m.id = e.dst where rel_type = 'contains')")
    + "select distinct a.m as src, b.m as dst from edges e join h a on a.c = e.src join h b on b.c = e.dst and b.n = a.n where e.rel_type = 'extends'",
    "seed_entities": S.with_(S.LATEST, S.QUERIES, S.ENTITIES, _SEEDS) + "select query_id, node as entity_id from seeds",
    "graph_boost_scored": S.with_(S.LATEST, S.QUERIES, S.ENTITIES, _SEEDS, S.EDGES, _UNDIRECTED, _ATTR, "reach as (select distinct node as origin, node, 0 as depth from seeds union select r.origin, u.dst, r.depth + 1 from reach r join und u on u.src = r.node where r.depth < 3)", "d as (select s.query_id, r.node, min(r.depth) as depth from seeds s join reach r on r.origin = s.node group by 1, 2)", "c as (select id as node, chunk_id from ents where chunk_id is not null union select entity_id, chunk_id from attr where chunk_id is not null and chunk_id <> -1)", "sc as (select query_id, chunk_id as id, max(0.2 * power(0.5, depth)) as score from d join c using (node) group by 1, 2)", recursive=True)
    + "select query_id, id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, id) n from sc) where n <= 50",
    "context_expand": S.with_(S.LATEST, S.EDGES, S.ENTITIES, S.RELATIONS, "w as (select src, dst, rel_type, case rel_type when 'calls' then 0.9 when 'imports' then 0.7 when 'extends' then 0.6 when 'implements' then 0.6 when 'overrides' then 0.55 when 'contains' then 0.4 when 'references' then 0.35 end as s from rels)", "seeds as (select distinct src as q from rels where src % 20 = 0)", "near as (select q, q as node from seeds union select q, dst from seeds join w on src = q where s is not null)",
    "f as (select n.q, w.dst as id, s from near n join w on w.src = n.node where s is not null union all select n.q, w.src, s from near n join w on w.dst = n.node where rel_type in ('calls', 'contains') union all select q, dst, 0.3 from seeds join rels on src = q union all select q, src, 0.3 from seeds join rels on dst = q)", "g as (select f.q, f.id, max(s) as score from f where f.id <> f.q group by 1, 2)")
    + "select q as query_id, id, score::double as score from (select g.*, row_number() over (partition by q order by score desc, l.importance desc, g.id) n from g join live l on l.id = g.id) where n <= 20",
    "context_expand_full": S.with_(S.LATEST, S.EDGES, S.ENTITIES, S.RELATIONS, "w as (select src, dst, rel_type, case rel_type when 'calls' then 0.9 when 'imports' then 0.7 when 'extends' then 0.6 when 'implements' then 0.6 when 'overrides' then 0.55 when 'contains' then 0.4 when 'references' then 0.35 end as s from rels)", "seeds as (select distinct src as q from rels where src % 20 = 0)", "one as (select q, q as node from seeds union select q, dst from seeds join w on src = q where s is not null)", "near as (select q, node from one union select q, dst from one join w on src = node where s is not null)",
    "f as (select n.q, w.dst as id, s from near n join w on w.src = n.node where s is not null union all select n.q, w.src, s from near n join w on w.dst = n.node where rel_type in ('calls', 'contains') union all select q, dst, 0.3 from seeds join rels on src = q union all select q, src, 0.3 from seeds join rels on dst = q)", "g as (select f.q, f.id, max(s) as score from f where f.id <> f.q group by 1, 2)")
    + "select q as query_id, id, score::double as score from (select g.*, row_number() over (partition by q order by score desc, l.importance desc, g.id) n from g join live l on l.id = g.id) where n <= 50",
    "facts_at": S.with_(_DEPS) + "select id, source_entity, target_entity, lower(trim(dep_type)) as dep_type from deps where valid_from <= timestamptz '2025-07-01 00:00:00+00' and (valid_to is null or timestamptz '2025-07-01 00:00:00+00' < valid_to)",
    "fact_history": "with d as (select distinct source_entity, target_entity, lower(trim(dep_type)) as dep_type, valid_from, valid_to from entity_dependencies) select source_entity, target_entity, dep_type, row_number() over (partition by source_entity, target_entity, dep_type order by valid_from, valid_to nulls last) as version, count(*) over (partition by source_entity, target_entity, dep_type) as versions, epoch_us(valid_from) as valid_from from d",
    "current_facts": S.with_(_DEPS) + f"select lower(trim(dep_type)) as dep_type, count(*) as facts, round(avg(strength), 6) as strength from deps where {_OPEN} group by 1",
    "supersede_facts": S.with_(_DEPS, "hit as (select distinct source_entity, target_entity, lower(trim(dep_type)) as t from deps where source_entity % 10 = 0)") + f"select lower(trim(d.dep_type)) as dep_type, count(*) filter ({_OPEN} and h.t is null) as open, count(*) as facts from deps d left join hit h on h.source_entity = d.source_entity and h.target_entity = d.target_entity and h.t = lower(trim(d.dep_type)) group by 1",
    "entity_upsert": S.with_(S.LATEST, "rows as (select name, chunk_type as entity_type, file_path, line_start, id as chunk_id from live where name is not null and chunk_type in ('function', 'method', 'class', 'struct', 'interface', 'trait', 'enum', 'type', 'constant', 'macro', 'module', 'impl') union all select distinct file_path, 'file', file_path, null::bigint, null::bigint from live where source_type = 'code')")
    + r"select trim(regexp_replace(lower(name), '\s+', ' ', 'g')) as canonical_name, count(*) as mentions, arg_max(entity_type, (coalesce(file_path, ''), coalesce(line_start, -1), coalesce(chunk_id, -1))) as entity_type, arg_max(chunk_id, (coalesce(file_path, ''), coalesce(line_start, -1), coalesce(chunk_id, -1))) filter (chunk_id is not null) as chunk_id from rows group by 1",
    "mention_counter": S.with_(S.ENTITIES, _ATTR, "m as (select entity_id, count(*) n from attr group by 1)") + "select entity_id, (coalesce(e.mentions, 0) + coalesce(m.n, 0))::bigint as mentions from (select id as entity_id, mentions from ents) e full join m using (entity_id)",
    "hints_template": S.with_(S.LATEST, _HINTS) + "select chunk_id, n::int as n, hint_text from hints",
    "hint_search": S.with_(S.LATEST, S.QUERIES, _HINTS, S.EDGES, S.ENTITIES, _REL_HINTS, "rh as (select entity_id, hint_text, hint_type from (select *, row_number() over (partition by entity_id order by way, hint_text) n from oh) where n <= 6)",
        "ah as (select chunk_id, hint_text, min(hint_type) as hint_type from (select chunk_id, hint_text, 'symbol' as hint_type from hints union all select e.chunk_id, hint_text, hint_type from rh join ents e on e.id = rh.entity_id where e.chunk_id is not null) group by 1, 2)",
        f"ht as (select chunk_id, hint_text, unnest({S.tokens('hint_text')}) as term from ah)", "hp as (select term, chunk_id, hint_text, count(*) as c from ht group by 1, 2, 3)", f"hl as (select chunk_id, hint_text, hint_type, len({S.tokens('hint_text')}) as len from ah)", "hc as (select count(*) docs, avg(len) mean from hl)", "hd as (select term, count(*) df from hp group by 1)",
        f"hw as (select distinct query_id, unnest({S.tokens('text')}) as term from queries)",
        "hr as (select query_id, p.chunk_id, p.hint_text, l.hint_type, -sum(case when ln((docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((docs - df + 0.5) / (df + 0.5)) end * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len / mean))) as rank from hw join hp p using (term) join hd using (term) join hl l on l.chunk_id = p.chunk_id and l.hint_text = p.hint_text, hc group by 1, 2, 3, 4)",
        "hb as (select * from (select *, row_number() over (partition by query_id order by round(rank, 9), chunk_id, hint_text) n from hr) where n <= 200)",
        "hn as (select query_id, chunk_id, least(1 - (rank - min(rank) over w) / greatest(abs(max(rank) over w - min(rank) over w), 0.001) + case when hint_type in ('caller', 'callee', 'heir', 'member', 'importer') then 0.15 else 0.0 end, 1.0) as s from hb window w as (partition by query_id))",
        "hs as (select query_id, chunk_id as id, max(s) as score from hn group by 1, 2)") + "select query_id, id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) n from hs) where n <= 20",
    "hints_concatenated": S.with_(S.LATEST, _HINTS) + "select chunk_id, string_agg(hint_text, ' ' order by n) as hints from hints group by 1",
    "hints_relational": S.with_(S.EDGES, S.ENTITIES, _REL_HINTS) + "select entity_id, n::int as n, hint_text, hint_type from (select *, row_number() over (partition by entity_id order by way, hint_text) n from oh) where n <= 6",
    "directory_communities": S.with_(S.LATEST, S.ENTITIES, _COMMUNITIES) + "select * from comm",
    "community_search": S.with_(S.LATEST, S.ENTITIES, _COMMUNITIES) + "select * from comm where contains(lower(path), 'token') order by chunk_count desc, path limit 20",
    "module_communities": S.with_(S.LATEST, S.EDGES, S.ENTITIES, S.RELATIONS, "p as (select distinct a.file_path as a, b.file_path as b from rels join live a on a.id = src join live b on b.id = dst where rel_type = 'imports' and a.file_path <> b.file_path)") + "select regexp_replace(a, '/[^/]*$', '') as path, count(*) as imports from p group by 1 order by imports desc, path limit 20",
    "type_hierarchy": S.with_(S.EDGES, S.ENTITIES, "c as (select dst, count(*) n from edges where rel_type in ('extends', 'implements') group by 1)") + "select * from (select dst as entity_id, name || ' hierarchy' as name, n as children from c join ents on ents.id = dst order by n desc, dst limit 10) where children >= 2",
    "community_members": S.with_(S.LATEST) + "select path, id, place from (select string_split(file_path, '/')[1] as path, id, row_number() over (partition by string_split(file_path, '/')[1] order by importance desc, id) place from live) where place <= 5",
    "community_summary": S.with_(S.LATEST, "r as (select *, string_split(file_path, '/')[1] as path from live)", "k as (select path, string_agg(n || ' ' || chunk_type, ', ' order by n desc, chunk_type) as kinds from (select path, chunk_type, count(*) n from r group by 1, 2) group by 1)", "i as (select path, string_agg(name, ', ' order by place) as keys from (select path, name, row_number() over (partition by path order by importance desc, id) place from r where importance >= 0.5 and name is not null) where place <= 8 group by 1)") + "select k.path, kinds, keys from k left join i on i.path = k.path",
}
