"""Queries of browsing, statistics, upkeep, sections and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.common import table
from chunkloom.functions import scalar
from chunkloom.operators import catalogue, chunks, entities, sections
from chunkloom.plans import sql as S
from chunkloom.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]

_AT = "2025-10-01 00:00:00"


def _live(spark, sf_dir):
    return chunks.live(table(spark, sf_dir, "chunks"))


def _at():
    return F.lit(_AT).cast("timestamp")


def stats_by_type(spark, sf_dir):
    return catalogue.counts(_live(spark, sf_dir), "chunk_type")


def stats_by_language(spark, sf_dir):
    return _live(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.count_distinct(F.when(F.col("chunk_type") == "function", F.col("name"))).alias("functions"))


def project_summary_counts(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("files", "entities", "entity_dependencies", "chunks_vec")}
    return catalogue.totals(_live(spark, sf_dir), t["files"], t["entities"], t["entity_dependencies"], t["chunks_vec"])


def health_report(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks")
    t = {n: table(spark, sf_dir, n).distinct() for n in ("entities", "entity_attributes", "entity_dependencies", "chunks_vec")}
    return catalogue.health(chunks.live(rows), chunks.latest(rows), t["entities"], t["entity_attributes"], t["entity_dependencies"], t["chunks_vec"])


def ls_filtered(spark, sf_dir):
    out = catalogue.ls(_live(spark, sf_dir), chunk_type="function", source_types=["code"], exclude=["docs/", "vendor/"])
    return out.select("id", "file_path", "name", "line_start")


def ls_tree(spark, sf_dir):
    return catalogue.tree(_live(spark, sf_dir).select(F.col("file_path").alias("path")))


def get_at_line(spark, sf_dir):
    """The chunk over line 2 of every file."""
    rows = _live(spark, sf_dir)
    return catalogue.get(rows, rows.select(F.col("file_path").alias("path"), F.lit(2).alias("line")).distinct())


def cat_rendered(spark, sf_dir):
    rows = _live(spark, sf_dir).where(F.col("name").isNotNull())
    return rows.select("id", F.sha2(catalogue.render(rows), 256).alias("digest"))


def diff_since(spark, sf_dir):
    return catalogue.diff_since(chunks.latest(table(spark, sf_dir, "chunks")), _at())


def unembedded(spark, sf_dir):
    """Live chunks without a vector, short and important ones first in line."""
    have = table(spark, sf_dir, "chunks_vec").where(F.size("embedding") > 0).select(F.col("chunk_id").alias("id")).distinct()
    return _live(spark, sf_dir).join(have, "id", "left_anti").select("id", F.length("content_raw").alias("length"))


def not_in_null_aware(spark, sf_dir):
    """Attributes whose chunk, if they name one, is not live."""
    attributes = table(spark, sf_dir, "entity_attributes").distinct().where(F.col("chunk_id").isNull() | (F.col("chunk_id") != -1))
    return catalogue.not_in(attributes, "chunk_id", _live(spark, sf_dir), "id").select("id", "chunk_id")


def orphans_cleaned(spark, sf_dir):
    attributes = table(spark, sf_dir, "entity_attributes").distinct()
    return catalogue.clean_orphans(attributes, "chunk_id", _live(spark, sf_dir), "id").groupBy("kind").agg(F.count("*").alias("n"))


def semi_exists(spark, sf_dir):
    """Entities with at least one constraint."""
    bound = table(spark, sf_dir, "entity_attributes").where(F.col("kind") == "constraint").select(F.col("entity_id").alias("id"))
    return table(spark, sf_dir, "entities").distinct().join(bound, "id", "left_semi").select("id", "canonical_name")


def prefix_join(spark, sf_dir):
    """Chunks under each second-level folder, by prefixes made equal rather than by LIKE."""
    rows = _live(spark, sf_dir).select("id", F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/").alias("path"))
    folders = table(spark, sf_dir, "files").select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("path")).distinct()
    return rows.join(folders, "path").groupBy("path").agg(F.count("*").alias("n"))


def tombstone_files(spark, sf_dir):
    """Code chunks that deleting every file of the first project would bury."""
    rows = _live(spark, sf_dir)
    project = F.split("file_path", "/")[0]
    first = rows.agg(F.min(project).alias("first"))  # one row
    files = rows.select("file_path", project.alias("first")).join(F.broadcast(first), "first").select(F.col("file_path").alias("path"))
    dead = chunks.tombstone(rows, files, _at())
    return dead.select("id", "is_deleted", F.unix_micros("deleted_at").alias("deleted_at"))


def purge_tombstones(spark, sf_dir):
    kept = chunks.purge(chunks.latest(table(spark, sf_dir, "chunks")), F.lit("2026-01-01 00:00:00").cast("timestamp"), 60)
    return kept.groupBy("is_deleted").agg(F.count("*").alias("n"))


def forget_knowledge(spark, sf_dir):
    rows = _live(spark, sf_dir)
    out = chunks.forget(rows, rows.where(F.col("id") % 3 == 0).select("id"), _at())
    return out.groupBy("source_type", "is_deleted").agg(F.count("*").alias("n"))


def modify_knowledge(spark, sf_dir):
    rows = _live(spark, sf_dir)
    out = chunks.modify(rows, rows.where(F.col("id") % 3 == 0).select("id", F.lit(0.99).alias("importance"), F.lit(None).cast("array<string>").alias("tags")))
    return out.groupBy("source_type").agg(F.round(F.sum("importance"), 4).alias("importance"))


def content_hash_dedup(spark, sf_dir):
    """One document per text, the smallest id, with the number of copies."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.groupBy(scalar.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def ingest_dedup(spark, sf_dir):
    """Memory documents as knowledge rows: one per text."""
    rows = _live(spark, sf_dir)
    new = table(spark, sf_dir, "documents").where((F.col("source_type") == "memory") & F.col("text").isNotNull())
    new = new.select(F.col("text").alias("content_raw"), "source_type", F.lit("fact").alias("chunk_type"), F.lit(None).cast("string").alias("name"), F.lit(0.7).alias("importance"))
    return chunks.ingest(rows, new, _at()).groupBy("added").agg(F.count("*").alias("n"))


def incremental_diff(spark, sf_dir):
    """Files between their first and their last indexing before and after a day."""
    f = table(spark, sf_dir, "files").distinct()

    def state(rows):
        return rows.groupBy("path").agg(F.max_by("hash", F.struct("indexed_at", "hash")).alias("hash"))

    return chunks.diff(state(f.where(F.col("indexed_at") <= _at())), state(f)).groupBy("status").agg(F.count("*").alias("n"))


def session_summary(spark, sf_dir):
    rows = _live(spark, sf_dir).where(F.col("source_type") == "memory").withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    out = chunks.session_summary(rows, "day")
    return out.select("day", "prefix", F.length("summary").alias("length"), F.size("members").alias("members"))


def language_detect(spark, sf_dir):
    f = table(spark, sf_dir, "files").select(F.trim("path").alias("path")).distinct()
    return f.groupBy(scalar.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


def calls_regex(spark, sf_dir):
    rows = _live(spark, sf_dir).where(F.col("chunk_type").isin("function", "method"))
    return rows.select("id", F.array_join(F.array_sort(sections.calls(F.col("content_raw"))), ",").alias("calls"))


def call_edges(spark, sf_dir):
    return sections.call_edges(_live(spark, sf_dir))


def imports_extracted(spark, sf_dir):
    rows = _live(spark, sf_dir).where(F.col("chunk_type") == "import")
    return rows.select("id", F.array_join(sections.imports(F.col("content_raw")), ",").alias("modules"))


def line_chunks(spark, sf_dir):
    rows = _live(spark, sf_dir).where(F.col("chunk_type") == "section")
    out = sections.line_sections(rows)
    return out.select("id", "line_start", "line_end", "name", F.sha2("content", 256).alias("digest"))


def markdown_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.col("text").alias("content_raw"))
    return sections.markdown_sections(rows).select("id", "line_start", "line_end", "level", "title")


def token_counts(spark, sf_dir):
    rows = _live(spark, sf_dir)
    return rows.groupBy("language").agg(F.sum(F.size(scalar.tokens(F.col("content_raw")))).alias("words"), F.sum(scalar.token_estimate(F.col("content_raw"))).alias("tokens"))


def episode_stats(spark, sf_dir):
    return entities.episodes(table(spark, sf_dir, "events")).groupBy("change_type").agg(F.count("*").alias("n"), F.sum("chunks_affected").alias("chunks"), F.count_distinct("file_path").alias("files"))


def recent_episodes(spark, sf_dir):
    """The latest 20 episodes; the limit is the report's."""
    e = entities.episodes(table(spark, sf_dir, "events"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "file_path", "change_type")


def file_episodes(spark, sf_dir):
    """Each user's latest episode and how many there were."""
    e = entities.episodes(table(spark, sf_dir, "events"))
    return e.groupBy("file_path").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))


def json_props_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.min("k").alias("least"), F.max("k").alias("most"))


def events_tumbling(spark, sf_dir):
    w = stream.tumbling(table(spark, sf_dir, "events"), "1 hour")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def events_sliding(spark, sf_dir):
    w = stream.tumbling(table(spark, sf_dir, "events"), "2 hours", "1 hour")
    return w.groupBy("event_type").agg(F.count("*").alias("windows"), F.max("n").alias("most"))


def events_session(spark, sf_dir):
    s = stream.sessions(table(spark, sf_dir, "events"), "6 hours")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def events_dedup(spark, sf_dir):
    """The first event of each user, type and hour."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return e.groupBy("user_id", "event_type", "hour").agg(F.min("event_id").alias("event_id")).select("user_id", "event_type", "event_id")


def facts_from_events(spark, sf_dir):
    """Each user's events as facts with the time until the next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("next", F.lead("ts").over(w))
    return e.groupBy("event_type").agg(F.count_if(F.col("next").isNull()).alias("open"), F.round(F.avg(F.timestamp_diff("MICROSECOND", "ts", "next") / 1e6), 3).alias("seconds"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (stats_by_type, stats_by_language, project_summary_counts, health_report, ls_filtered, ls_tree, get_at_line, cat_rendered, diff_since, unembedded, not_in_null_aware, orphans_cleaned, semi_exists, prefix_join, tombstone_files, purge_tombstones, forget_knowledge, modify_knowledge, content_hash_dedup, ingest_dedup, incremental_diff, session_summary, language_detect, calls_regex, call_edges, imports_extracted, line_chunks, markdown_sections, token_counts, episode_stats, recent_episodes, file_episodes, json_props_extract, events_tumbling, events_sliding, events_session, events_dedup, facts_from_events)
}

_AT_SQL = f"timestamptz '{_AT}+00'"
_EP = "ep as (select event_id, 'user/' || user_id as file_path, case event_type when 'signup' then 'added' when 'error' then 'deleted' else 'modified' end as change_type, ts, json_extract(props, '$.k')::bigint as chunks_affected from events)"
_ATTR = "attr as (select distinct * from entity_attributes)"
_CALLS = r"list_distinct(list_filter(regexp_extract_all(content_raw, '(?:^|[^.\w])(\w+)\s*\(', 1), lambda x: not list_contains([" + ", ".join(f"'{k}'" for k in sections.KEYWORDS) + "], x)))"

SQL: dict[str, str] = {
    "stats_by_type": S.with_(S.LATEST) + "select chunk_type, count(*) as n from live group by 1",
    "stats_by_language": S.with_(S.LATEST) + "select language, count(*) as n, count(distinct file_path) as files, count(distinct case when chunk_type = 'function' then name end) as functions from live group by 1",
    "project_summary_counts": S.with_(S.LATEST) + "select 'chunks' as what, count(*) as n from live union all select 'files', count(distinct path) from files union all select 'entities', count(distinct id) from entities union all select 'dependencies', count(distinct id) from entity_dependencies union all select 'embedded', count(*) from live where id in (select chunk_id from chunks_vec)",
    "health_report": S.with_(S.LATEST, S.ENTITIES, _ATTR, "d as (select distinct * from entity_dependencies)", "v as (select distinct chunk_id from chunks_vec)")
    + """select 'tombstones' as what, count(*) as n from latest where is_deleted union all select 'attributes_without_entity', count(*) from attr where entity_id not in (select id from ents)
union all select 'attributes_without_chunk', count(*) from attr where chunk_id <> -1 and chunk_id not in (select id from live) union all select 'dependencies_without_source', count(*) from d where source_entity not in (select id from ents)
union all select 'dependencies_without_target', count(*) from d where target_entity not in (select id from ents) union all select 'vectors_without_chunk', count(*) from v where chunk_id not in (select id from live)
union all select 'chunks_without_vector', count(*) from live where id not in (select chunk_id from v) union all select 'doubled_entity_names', count(*) from (select canonical_name from ents group by 1 having count(*) > 1)""",
    "ls_filtered": S.with_(S.LATEST) + "select id, file_path, name, line_start from live where chunk_type = 'function' and source_type = 'code' and not starts_with(file_path, 'docs/') and not starts_with(file_path, 'vendor/')",
    "ls_tree": S.with_(S.LATEST, "p as (select distinct array_to_string(parts[1:i], '/') as path from (select string_split(file_path, '/') as parts from live), unnest(range(1, len(parts) + 1)) as t(i))") + "select path, (len(string_split(path, '/')) - 1)::int as depth, repeat(' ', 2 * (len(string_split(path, '/')) - 1)) || string_split(path, '/')[-1] as line from p",
    "get_at_line": S.with_(S.LATEST) + "select file_path as path, 2 as line, arg_max(id, (importance, -id)) as id from live where line_start <= 1 and line_end >= 1 group by 1",
    "cat_rendered": S.with_(S.LATEST) + "select id, sha256('### ' || name || chr(10) || '**File:** `' || file_path || '` **Lines:** ' || (line_start + 1) || '-' || (line_end + 1) || ' **Type:** ' || chunk_type || chr(10) || chr(10) || '```' || coalesce(language, '') || chr(10) || coalesce(content_raw, '') || chr(10) || '```' || chr(10)) as digest from live where name is not null",
    "diff_since": S.with_(S.LATEST) + f"select id, file_path, case when is_deleted then 'deleted' when created_at > {_AT_SQL} then 'added' else 'modified' end as change from latest where updated_at > {_AT_SQL}",
    "unembedded": S.with_(S.LATEST) + "select id, length(content_raw)::int as length from live where id not in (select chunk_id from chunks_vec where len(embedding) > 0)",
    "not_in_null_aware": S.with_(S.LATEST, _ATTR) + "select id, chunk_id from attr where chunk_id <> -1 and chunk_id not in (select id from live)",
    "orphans_cleaned": S.with_(S.LATEST, _ATTR) + "select kind, count(*) as n from attr where chunk_id is null or chunk_id in (select id from live) group by 1",
    "semi_exists": S.with_(S.ENTITIES) + "select id, canonical_name from ents where exists (select 1 from entity_attributes a where a.entity_id = ents.id and kind = 'constraint')",
    "prefix_join": S.with_(S.LATEST, "f as (select distinct array_to_string(string_split(path, '/')[1:2], '/') as path from files)") + "select f.path, count(*) as n from live l join f on array_to_string(string_split(l.file_path, '/')[1:2], '/') = f.path group by 1",
    "tombstone_files": S.with_(S.LATEST) + f"select id, true as is_deleted, epoch_us({_AT_SQL}) as deleted_at from live where source_type = 'code' and string_split(file_path, '/')[1] = (select min(string_split(file_path, '/')[1]) from live)",
    "purge_tombstones": S.with_(S.LATEST) + "select is_deleted, count(*) as n from latest where not coalesce(is_deleted and coalesce(deleted_at, updated_at) < timestamptz '2026-01-01 00:00:00+00' - interval 60 day, false) group by 1",
    "forget_knowledge": S.with_(S.LATEST) + "select source_type, (id % 3 = 0 and source_type <> 'code') as is_deleted, count(*) as n from live group by 1, 2",
    "modify_knowledge": S.with_(S.LATEST) + "select source_type, round(sum(case when id % 3 = 0 and source_type <> 'code' then 0.99 else importance end), 4) as importance from live group by 1",
    "content_hash_dedup": "select sha256(text) as hash, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1",
    "ingest_dedup": S.with_(S.LATEST, "n as (select distinct sha256(text) as h from documents where source_type = 'memory' and text is not null)") + "select h not in (select content_hash from live where source_type = 'memory') as added, count(*) as n from n group by 1",
    "incremental_diff": f"with f as (select distinct * from files), a as (select path, arg_max(hash, (indexed_at, hash)) as h from f where indexed_at <= {_AT_SQL} group by 1), b as (select path, arg_max(hash, (indexed_at, hash)) as h from f group by 1) select case when a.h is null then 'added' when b.h is null then 'removed' when a.h = b.h then 'unchanged' else 'updated' end as status, count(*) as n from a full join b using (path) group by 1",
    "language_detect": "with f as (select distinct trim(path) as path from files), n as (select lower(string_split(path, '/')[-1]) as name from f), l as (select case when starts_with(name, '.env') then 'dotenv' else coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in scalar.FILE_NAMES.items()) + "}[name], map {" + ", ".join(f"'{k}': '{v}'" for k, v in scalar.LANGUAGES.items()) + r"}[regexp_extract(name, '\.([^.]+)$', 1)]) end as language from n) select language, count(*) as n from l group by 1",
    "session_summary": S.with_(S.LATEST, "m as (select *, strftime(created_at, '%Y-%m-%d') as day from live where source_type = 'memory')", "g as (select day, count(*) as members, min(file_path) as lo, max(file_path) as hi, string_agg(coalesce(name, 'item') || ': ' || substr(content_raw, 1, 200), chr(10) order by id) as said from m group by 1 having count(*) > 1)") + "select day, lo[:list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda k: lo[:k] = hi[:k]))] as prefix, least(length(said), 4000)::int as length, members::int as members from g",
    "calls_regex": S.with_(S.LATEST) + f"select id, array_to_string(list_sort({_CALLS}), ',') as calls from live where chunk_type in ('function', 'method')",
    "call_edges": S.with_(S.LATEST, f"c as (select id as src, string_split(file_path, '/')[1] as project, unnest({_CALLS}) as name from live where chunk_type in ('function', 'method', 'section'))") + "select distinct c.src, d.id as dst from c join live d on string_split(d.file_path, '/')[1] = c.project and d.name = c.name and d.chunk_type in ('function', 'method', 'class', 'struct') where c.src <> d.id",
    "line_chunks": S.with_(S.LATEST, "l as (select id, unnest(range(0, len(a))) as n, unnest(a) as line from (select id, string_split(replace(content_raw, chr(13) || chr(10), chr(10)), chr(10)) as a from live where chunk_type = 'section'))", "o as (select *, (n > 0 and (" + " or ".join(f"starts_with(ltrim(line, ' '), '{p}')" for p in sections.PREFIXES) + "))::int as open from l)", "p as (select *, sum(open) over (partition by id order by n) as part from o)", "q as (select *, (row_number() over (partition by id, part order by n) - 1) // 50 as piece from p)", "g as (select id, part, piece, min(n) as line_start, max(n) + 1 as line_end, string_agg(line, chr(10) order by n) as content from q group by 1, 2, 3)")
    + "select id, line_start::int as line_start, line_end::int as line_end, case when length(trim(string_split(content, chr(10))[1])) < 80 then trim(string_split(content, chr(10))[1]) end as name, sha256(content) as digest from g",
    "markdown_sections": r"""with l as (select id, unnest(range(0, len(a))) as n, unnest(a) as line from (select doc_id as id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as a from documents where text is not null)),
f as (select *, regexp_matches(line, '^\s*(```|~~~)') as fence, sum(regexp_matches(line, '^\s*(```|~~~)')::int) over (partition by id order by n) % 2 = 1 as inside from l),
h as (select *, regexp_matches(line, '^#{1,6} ') and not inside and not fence as head from f), p as (select *, sum(head::int) over (partition by id order by n) as part from h),
g as (select id, part, min(n) as line_start, max(n) + 1 as line_end, arg_min(line, n) as first from p group by 1, 2)
select id, line_start::int as line_start, line_end::int as line_end, case when part > 0 then length(regexp_extract(first, '^(#+)', 1)) else 0 end::int as level, case when part > 0 then trim(regexp_replace(first, '^#+', '')) end as title from g""",
    "token_counts": S.with_(S.LATEST) + f"select language, sum(len({S.tokens('content_raw')}))::bigint as words, sum(ceil(strlen(content_raw) * 10 / 36))::bigint as tokens from live group by 1",
    "episode_stats": S.with_(_EP) + "select change_type, count(*) as n, sum(chunks_affected)::bigint as chunks, count(distinct file_path) as files from ep group by 1",
    "recent_episodes": S.with_(_EP) + "select event_id, file_path, change_type from ep order by ts desc, event_id desc limit 20",
    "file_episodes": S.with_(_EP) + "select file_path, arg_max(event_id, (ts, event_id)) as last, count(*) as n from ep group by 1",
    "json_props_extract": "select event_type, sum(json_extract(props, '$.k')::int)::bigint as k, min(json_extract(props, '$.k')::int) as least, max(json_extract(props, '$.k')::int) as most from events group by 1",
    "events_tumbling": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "events_sliding": "with w as (select date_trunc('hour', ts) - interval (k) hour as s, event_type from events, unnest([0, 1]) as t(k)), c as (select s, event_type, count(*) n from w group by 1, 2) select event_type, count(*) as windows, max(n) as most from c group by 1",
    "events_session": "with g as (select *, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k",
    "events_dedup": "select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type, date_trunc('hour', ts)",
    "facts_from_events": "with e as (select *, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) select event_type, count(*) filter (nxt is null) as open, round(avg((epoch_us(nxt) - epoch_us(ts)) / 1e6), 3) as seconds from e group by 1",
}
