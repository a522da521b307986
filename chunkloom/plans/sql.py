"""Parts of SQL that several oracle queries share; DuckDB's dialect."""

#: The state of chunks: latest row of each id, then those that are not deleted.
LATEST = """latest as (select * exclude (rn) from (select *, row_number() over (partition by id order by coalesce(updated_at, timestamptz '0001-01-01 00:00:00+00') desc, is_deleted desc) rn from chunks where id is not null) where rn = 1),
live as (select * from latest where not is_deleted)"""

#: Queries: the names of every twentieth live chunk, in words.
QUERIES = r"""queries as (select id as query_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as text from live where id % 20 = 0 and name is not null)"""


def tokens(column: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({column}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


#: Postings, lengths and BM25 of the queries over the live chunks.
BM25 = f"""terms as (
select id, unnest({tokens('name')}) as term, 'n' as f from live union all select id, unnest({tokens('signature')}), 's' from live
union all select id, unnest({tokens('content_raw')}), 'c' from live union all select id, unnest({tokens('file_path')}), 'p' from live),
postings as (select term, id, count(*) filter (f = 'n') n, count(*) filter (f = 's') s, count(*) filter (f = 'c') c, count(*) filter (f = 'p') p from terms group by term, id),
lengths as (select l.id, coalesce(t.len, 0) len from live l left join (select id, count(*) len from terms group by id) t on t.id = l.id),
corpus as (select count(*) docs, avg(len) mean from lengths),
df as (select term, count(*) df from postings group by term),
wanted as (select distinct query_id, unnest({tokens('text')}) as term from queries),
parts as (select w.query_id, p.id, case when ln((docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((docs - df + 0.5) / (df + 0.5)) end as idf,
n + s + c + p as one, 10 * n + 5 * s + c + p as heavy, 1.2 * (0.25 + 0.75 * len / mean) as norm
from wanted w join postings p on p.term = w.term join df on df.term = w.term join lengths l on l.id = p.id, corpus),
bm25 as (select query_id, id, -sum(idf * one * 2.2 / (one + norm)) as rank, -sum(idf * heavy * 2.2 / (heavy + norm)) as weighted from parts group by query_id, id)"""

BEST = "best as (select * exclude (place) from (select *, row_number() over (partition by query_id order by round(weighted, 9), id) place from bm25) where place <= 200)"

NORMAL = "normal as (select *, 1 - (rank - min(rank) over w) / greatest(abs(max(rank) over w - min(rank) over w), 0.001) as fts_rank from best window w as (partition by query_id))"

#: The three-factor score with name bonus and name hit; as of the fixed time.
SCORED = f"""asked as (select query_id, {tokens('text')} as terms, list_filter({tokens('text')}, lambda t: strlen(t) > 2) as long from queries),
joined as (select n.query_id, n.id, n.fts_rank, c.name, c.signature, c.file_path, c.importance, c.updated_at, a.long,
len(list_filter(a.long, lambda t: contains(lower(c.name), t))) as in_name,
len(list_filter(a.long, lambda t: contains(lower(c.name), t) or contains(lower(coalesce(c.signature, '')), t))) as in_any,
len(list_filter(a.long, lambda t: contains(lower(c.name), t) and length(c.name) > length(t) + 2)) as loose
from normal n join asked a on a.query_id = n.query_id join live c on c.id = n.id),
bonus as (select *, case when name is null or len(long) = 0 then 0.0 when in_name / len(long) >= 0.8 then 0.4 when in_any / len(long) >= 0.8 then 0.3
when in_name / len(long) >= 0.5 then 0.25 when in_any / len(long) >= 0.5 then 0.15 when in_name > 0 then 0.12 + 0.05 * loose when in_any > 0 then 0.06 else 0.0 end as bonus from joined),
scored as (select query_id, id, fts_rank, bonus, file_path, name, importance,
least(fts_rank + bonus, 1.0) * coalesce(power(2.0, -greatest((epoch_us(timestamptz '2026-01-01 00:00:00+00') - epoch_us(updated_at)) / 86400000000.0, 0) / 90), 1.0) * importance
* case when coalesce(in_name, 0) > 0 then 1.4 else 1.0 end as score from bonus),
content as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) place from scored) where place <= 30)"""

#: Open, cleanly written, distinct entity edges.
EDGES = """edges as (select distinct source_entity as src, target_entity as dst, lower(trim(dep_type)) as rel_type from entity_dependencies
where (valid_to is null or valid_to::date = date '9999-12-31') and source_entity is not null and target_entity is not null)"""

ENTITIES = "ents as (select distinct * from entities)"

#: Chunk edges from entity edges.
RELATIONS = """rels as (select distinct a.chunk_id as src, b.chunk_id as dst, e.rel_type from edges e join ents a on a.id = e.src join ents b on b.id = e.dst
where a.chunk_id is not null and b.chunk_id is not null and a.chunk_id <> b.chunk_id)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n"
