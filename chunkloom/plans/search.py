"""Queries of retrieval: full text, scoring, vectors, fusion, budgets and quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.common import Scratch, table
from chunkloom.functions import scalar
from chunkloom.operators import fulltext, ranking
from chunkloom.operators.chunks import live
from chunkloom.plans import sql as S

Query = Callable[[SparkSession, str], DataFrame]

#: Kinds of chunks whose names are asked for in an evaluation.
EVALUATED = ("function", "method", "class", "interface")
#: Added before a score is rounded, so that products which end in 5 round alike everywhere.
OFF = 1e-9
#: The time that recency refers to; fixed, so that results repeat.
AS_OF = "2026-01-01 00:00:00"
#: Columns that full text reads, and that the score of content search reads besides.
FOUND_BY = ("id", *fulltext.FIELDS)
SCORED_BY = (*FOUND_BY, "importance", "updated_at")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def chunks_and_queries(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("*",)) -> tuple[DataFrame, DataFrame]:
    """Live chunks, and the queries: the names, in words, of those whose id is divisible by 20."""
    # the latest state is read several times; written once, it is shuffled once, with no more columns than are wanted
    rows = Scratch(spark, "search").cut(live(table(spark, sf_dir, "chunks")).select(*columns))
    named = rows.where((F.col("id") % 20 == 0) & F.col("name").isNotNull())
    return rows, named.select(F.col("id").alias("query_id"), scalar.name_words(F.col("name")).alias("text"))


def _best(spark: SparkSession, sf_dir: str, k: int, by: str) -> tuple[DataFrame, DataFrame]:
    """The queries as asked, and the best k of those that ask, in the order of column `by`."""
    rows, queries = chunks_and_queries(spark, sf_dir, FOUND_BY)
    every = fulltext.asked(queries)
    return every, fulltext.top(fulltext.best(rows, fulltext.asking(every), k, by=by), k, F.round(by, 9), F.col("id"))


def fts_bm25_topk(spark, sf_dir):
    every, best = _best(spark, sf_dir, 10, "rank")
    return fulltext.answered(every, best.select("query_id", "id", F.round("rank", 6).alias("rank"), "place"))


def fts_weighted_columns(spark, sf_dir):
    every, best = _best(spark, sf_dir, 10, "weighted")
    return fulltext.answered(every, best.select("query_id", "id", F.round("weighted", 6).alias("weighted"), "place"))


def fts_normalized(spark, sf_dir):
    every, best = _best(spark, sf_dir, fulltext.CANDIDATES, "weighted")
    out = best.withColumn("fts_rank", fulltext.normalised(best)).drop("place")
    out = fulltext.top(out, 10, F.desc(F.round("fts_rank", 9)), F.col("id")).select("query_id", "id", F.round("fts_rank", 6).alias("fts_rank"), "place")
    return fulltext.answered(every, out)


def _content(spark, sf_dir):
    rows, queries = chunks_and_queries(spark, sf_dir, SCORED_BY)
    return fulltext.content_search(rows, queries, as_of())


def content_search(spark, sf_dir):
    return _content(spark, sf_dir).select("query_id", "id", F.round("score", 6).alias("score"), F.round("fts_rank", 6).alias("fts_rank"))


def search_dampened(spark, sf_dir):
    """Content search, boosted by importance, dampened per file, best 10."""
    found = _content(spark, sf_dir).withColumn("score", scalar.importance_boost(F.col("score"), F.col("importance")))
    out = ranking.dampen(found)
    return fulltext.top(out, 10, F.desc(F.round("score", 9)), F.col("id")).select("query_id", "id", F.round("score", 6).alias("score"), "place")


def name_match_bonus(spark, sf_dir):
    rows, queries = chunks_and_queries(spark, sf_dir, FOUND_BY)
    every = fulltext.asked(queries)
    q = fulltext.asking(every)
    best = fulltext.top(fulltext.best(rows, q, fulltext.CANDIDATES), fulltext.CANDIDATES, F.round("weighted", 9), F.col("id")).select("query_id", "id")
    out = best.join(q, "query_id").join(rows.select("id", "name", "signature"), "id")
    sums = out.withColumn("bonus", scalar.name_bonus(F.col("terms"), F.col("name"), F.col("signature"))).where("bonus > 0").groupBy("query_id").agg(F.count("*").alias("rows"), F.round(F.sum("bonus"), 6).alias("bonus"))
    return fulltext.answered(every, sums)


def _evaluated(spark, sf_dir, by=(), unique=False):
    """Quality of content search where the wanted chunk is the one that a query names.

    The queries are the names of every twentieth live code chunk of the kinds
    that are asked for, of more than three characters.  Recency is neutral.
    """
    rows = Scratch(spark, "evaluation").cut(live(table(spark, sf_dir, "chunks")).select(*SCORED_BY, "chunk_type", "source_type"))
    wanted = rows.where(F.col("chunk_type").isin(*EVALUATED) & (F.col("source_type") == "code") & (F.length("name") > 3))
    if unique:
        once = rows.groupBy(F.lower("name").alias("_low")).agg(F.count("*").alias("_n")).where("_n = 1")
        wanted = wanted.join(once, F.lower("name") == F.col("_low"), "left_semi")
    queries = wanted.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), scalar.name_words(F.col("name")).alias("text"), "chunk_type")
    found = fulltext.content_search(rows, queries, F.lit("1970-01-01").cast("timestamp"))
    found = fulltext.top(found, 10, F.desc(F.round("score", 9)), F.col("id"))
    q = ranking.quality(found, queries.select("query_id", F.col("query_id").alias("id"), *by), by=by)
    return q.select(*by, "queries", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "hit_10", "mrr")])


def eval_hit_at_k_mrr(spark, sf_dir):
    return _evaluated(spark, sf_dir)


def eval_by_type(spark, sf_dir):
    return _evaluated(spark, sf_dir, by=("chunk_type",))


def eval_unique_names(spark, sf_dir):
    """As `eval_hit_at_k_mrr`, for names that a single chunk has."""
    return _evaluated(spark, sf_dir, unique=True)


def _results(spark, sf_dir):
    return table(spark, sf_dir, "search_results").distinct()


def recency_decay(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("query_id", "chunk_id", F.round(scalar.recency(F.col("last_accessed"), as_of()), 6).alias("recency"))


def three_factor(spark, sf_dir):
    r = _results(spark, sf_dir)
    score = F.col("score") * scalar.recency(F.col("last_accessed"), as_of()) * F.col("importance")
    return r.select("query_id", "chunk_id", F.round(score, 6).alias("score"))


def importance_boost(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("query_id", "chunk_id", F.round(scalar.importance_boost(F.col("score"), F.col("importance")), 6).alias("score"))


def diversity_dampen(spark, sf_dir):
    out = ranking.dampen(_results(spark, sf_dir), ident="chunk_id")
    return out.select("query_id", "chunk_id", F.round(F.col("score") + OFF, 6).alias("score"))


def token_budget_cut(spark, sf_dir):
    """Results of each query, by score, that fit 400 tokens."""
    sizes = live(table(spark, sf_dir, "chunks")).select(F.col("id").alias("chunk_id"), scalar.token_estimate(F.col("content_raw")).alias("tokens"))
    rows = _results(spark, sf_dir).join(sizes, "chunk_id")
    out = ranking.within_budget(rows, 400, "tokens", "query_id", F.desc("score"), F.col("chunk_id"))
    return out.select("query_id", "chunk_id", "tokens", "used", "place")


def _near(spark, sf_dir, metric):
    rows = table(spark, sf_dir, "chunks_vec").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")).where(F.size("v") == 64)
    return ranking.nearest(rows, rows.where(F.col("id") % 20 == 0), 5, metric)


def vec_knn_l2(spark, sf_dir):
    return _near(spark, sf_dir, "l2").select("query_id", "id", F.round("distance", 4).alias("distance"))


def vec_knn_cosine(spark, sf_dir):
    return _near(spark, sf_dir, "cosine").select("query_id", "id", F.round("distance", 4).alias("distance"))


def vec_knn_filtered(spark, sf_dir):
    """Nearest functions only: the filter comes before the search."""
    only = live(table(spark, sf_dir, "chunks")).where(F.col("chunk_type") == "function").select("id")
    rows = table(spark, sf_dir, "chunks_vec").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")).where(F.size("v") == 64)
    found = ranking.nearest(rows.join(only, "id", "left_semi"), rows.where(F.col("id") % 20 == 0), 3)
    return found.select("query_id", "id", F.round("distance", 4).alias("distance"))


def layered_fusion(spark, sf_dir):
    """Full-text results with the vector layer folded in, best 10."""
    found = _results(spark, sf_dir)
    text = found.where(F.col("fts_rank").isNotNull()).select("query_id", F.col("chunk_id").alias("id"), "score")
    near = found.where(F.col("vec_distance").isNotNull()).select("query_id", F.col("chunk_id").alias("id"), F.col("vec_distance").alias("distance"), F.col("importance").alias("weight"))
    out = ranking.add_vector_layer(text, near)
    return fulltext.top(out, 10, F.desc(F.round("score", 9)), F.col("id")).select("query_id", "id", F.round(F.col("score") + OFF, 6).alias("score"), "place")


def short_circuit(spark, sf_dir):
    """Whether full text alone answers a query: three results of 0.7 and a best above 0.85, on normalised scores."""
    w = Window.partitionBy("query_id")
    norm = (F.col("score") - F.min("score").over(w)) / F.greatest(F.max("score").over(w) - F.min("score").over(w), F.lit(0.001))
    rows = _results(spark, sf_dir).withColumn("norm", norm)
    return rows.groupBy("query_id").agg(((F.count_if(F.col("norm") >= 0.7) >= 3) & (F.max("norm") > 0.85)).alias("enough"))


def multi_project_topk(spark, sf_dir):
    """The best 3 results of each project (first folder) of each query, then the best 10 of the query."""
    rows = _results(spark, sf_dir).withColumn("project", F.split(F.regexp_replace(F.trim("file_path"), r"^\./", ""), r"[/\\]")[0])
    w = Window.partitionBy("query_id", "project").orderBy(F.desc("score"), "chunk_id")
    own = rows.withColumn("p", F.row_number().over(w)).where("p <= 3")
    return fulltext.top(own, 10, F.desc("score"), F.col("chunk_id")).select("query_id", "project", "chunk_id", "place")


def layered_search(spark, sf_dir):
    """The flagship: full text, entity graph and vectors fused, boosted and dampened, for all queries at once."""
    from chunkloom.operators import search

    rows, queries = chunks_and_queries(spark, sf_dir)
    t = {n: table(spark, sf_dir, n) for n in ("entities", "entity_attributes", "entity_dependencies", "chunks_vec")}
    return search.layered(rows, queries, t["entities"], t["entity_attributes"], t["entity_dependencies"], t["chunks_vec"], as_of(), written=True)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (fts_bm25_topk, fts_weighted_columns, fts_normalized, content_search, search_dampened, name_match_bonus, eval_hit_at_k_mrr, eval_by_type, eval_unique_names, recency_decay, three_factor, importance_boost, diversity_dampen, token_budget_cut, vec_knn_l2, vec_knn_cosine, vec_knn_filtered, layered_fusion, short_circuit, multi_project_topk, layered_search)
}

_KEY = "case when len(string_split(name, ':')) >= 3 and string_split(name, ':')[1] in ('locomo', 'locomo-fact') then string_split(name, ':')[2] || ':' || string_split(name, ':')[3] else coalesce(file_path, '') end"


def _dampened(source: str, ident: str) -> str:
    return f"""keyed as (select *, {_KEY} as k from {source}),
nth as (select *, row_number() over (partition by query_id, k order by round(score, 9) desc, {ident}) n, min(k) over (partition by query_id) <> max(k) over (partition by query_id) as several from keyed),
damp as (select *, score * case when several then power(0.85, n - 1) else 1.0 end as damped from nth)"""


_SR = "sr as (select distinct * from search_results)"
_RECENCY = "coalesce(power(2.0, -greatest((epoch_us(timestamptz '2026-01-01 00:00:00+00') - epoch_us(last_accessed)) / 86400000000.0, 0) / 90), 1.0)"
_VEC = "v as (select distinct chunk_id as id, embedding::double[64] as e from chunks_vec where len(embedding) = 64)"
_TOP = "select query_id, id, round({0}, 6) as {0}, place from (select *, row_number() over (partition by query_id order by round({0}, 9) {1}, id) place from {2}) where place <= 10"

_EVAL = S.QUERIES.replace("id % 20 = 0 and name is not null", "id % 20 = 0 and length(name) > 3 and source_type = 'code' and chunk_type in ('function', 'method', 'class', 'interface')")
_NEUTRAL = S.SCORED.replace("coalesce(power(2.0, -greatest((epoch_us(timestamptz '2026-01-01 00:00:00+00') - epoch_us(updated_at)) / 86400000000.0, 0) / 90), 1.0)", "1.0")
_UNIQUE = _EVAL.replace("length(name) > 3", "length(name) > 3 and lower(name) in (select lower(name) from live group by 1 having count(*) = 1)")
_HITS = ", ".join(f"round(avg(case when place <= {k} then 1.0 else 0.0 end), 6) as hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / place, 0.0)), 6) as mrr"
_FIRSTS = "firsts as (select q.query_id, min(c.place) as place from queries q left join content c on c.query_id = q.query_id and c.id = q.query_id and c.place <= 10 group by q.query_id)"

SQL: dict[str, str] = {
    "eval_by_type": S.with_(S.LATEST, _EVAL, S.BM25, S.BEST, S.NORMAL, _NEUTRAL, _FIRSTS) + f"select chunk_type, count(*) as queries, {_HITS} from firsts f join live on live.id = f.query_id group by 1",
    "eval_unique_names": S.with_(S.LATEST, _UNIQUE, S.BM25, S.BEST, S.NORMAL, _NEUTRAL, _FIRSTS) + f"select count(*) as queries, {_HITS} from firsts",
    "fts_bm25_topk": S.with_(S.LATEST, S.QUERIES, S.BM25) + _TOP.format("rank", "", "bm25"),
    "fts_weighted_columns": S.with_(S.LATEST, S.QUERIES, S.BM25) + _TOP.format("weighted", "", "bm25"),
    "fts_normalized": S.with_(S.LATEST, S.QUERIES, S.BM25, S.BEST, S.NORMAL) + _TOP.format("fts_rank", "desc", "normal"),
    "content_search": S.with_(S.LATEST, S.QUERIES, S.BM25, S.BEST, S.NORMAL, S.SCORED) + "select query_id, id, round(score, 6) as score, round(fts_rank, 6) as fts_rank from content",
    "search_dampened": S.with_(S.LATEST, S.QUERIES, S.BM25, S.BEST, S.NORMAL, S.SCORED, "boosted as (select * replace (score * (0.95 + 0.05 * importance) as score) from content)", _dampened("boosted", "id"), "d as (select query_id, id, damped as score from damp)") + _TOP.format("score", "desc", "d"),
    "name_match_bonus": S.with_(S.LATEST, S.QUERIES, S.BM25, S.BEST, S.NORMAL, S.SCORED) + "select query_id, count(*) as rows, round(sum(bonus), 6) as bonus from scored where bonus > 0 group by query_id",
    "eval_hit_at_k_mrr": S.with_(S.LATEST, _EVAL, S.BM25, S.BEST, S.NORMAL, _NEUTRAL, "firsts as (select q.query_id, min(c.place) as place from queries q left join content c on c.query_id = q.query_id and c.id = q.query_id and c.place <= 10 group by q.query_id)")
    + "select count(*) as queries, " + ", ".join(f"round(avg(case when place <= {k} then 1.0 else 0.0 end), 6) as hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / place, 0.0)), 6) as mrr from firsts",
    "recency_decay": S.with_(_SR) + f"select query_id, chunk_id, round({_RECENCY}, 6) as recency from sr",
    "three_factor": S.with_(_SR) + f"select query_id, chunk_id, round(score * {_RECENCY} * importance, 6) as score from sr",
    "importance_boost": S.with_(_SR) + "select query_id, chunk_id, round(score * (0.95 + 0.05 * importance), 6) as score from sr",
    "diversity_dampen": S.with_(_SR, _dampened("sr", "chunk_id")) + f"select query_id, chunk_id, round(damped + {OFF}, 6) as score from damp",
    "token_budget_cut": S.with_(S.LATEST, _SR, "r as (select s.query_id, s.chunk_id, s.score, ceil(strlen(l.content_raw) * 10 / 36)::bigint as tokens from sr s join live l on l.id = s.chunk_id)", "u as (select *, sum(tokens) over w as used, row_number() over w as place from r window w as (partition by query_id order by score desc, chunk_id rows unbounded preceding))", "o as (select *, min(case when used > 400 and place > 1 then place end) over (partition by query_id) as cut from u)")
    + "select query_id, chunk_id, tokens, used::bigint as used, place from o where cut is null or place < cut",
    "vec_knn_l2": S.with_(_VEC) + "select query_id, id, round(d, 4) as distance from (select q.id as query_id, v.id, list_distance(q.e, v.e) as d, row_number() over (partition by q.id order by round(list_distance(q.e, v.e), 9), v.id) n from v q, v where q.id % 20 = 0 and q.id <> v.id) where n <= 5",
    "vec_knn_cosine": S.with_(_VEC.replace("where len(embedding) = 64", "where len(embedding) = 64 and list_max(list_transform(embedding, lambda x: abs(x))) > 0")) + "select query_id, id, round(d, 4) as distance from (select q.id as query_id, v.id, 1 - list_cosine_similarity(q.e, v.e) as d, row_number() over (partition by q.id order by round(1 - list_cosine_similarity(q.e, v.e), 9), v.id) n from v q, v where q.id % 20 = 0 and q.id <> v.id) where n <= 5",
    "vec_knn_filtered": S.with_(S.LATEST, _VEC, "f as (select v.* from v where id in (select id from live where chunk_type = 'function'))") + "select query_id, id, round(d, 4) as distance from (select q.id as query_id, f.id, list_distance(q.e, f.e) as d, row_number() over (partition by q.id order by round(list_distance(q.e, f.e), 9), f.id) n from v q, f where q.id % 20 = 0 and q.id <> f.id) where n <= 3",
    "layered_fusion": S.with_(_SR, "t as (select query_id, chunk_id as id, score from sr where fts_rank is not null)", "n as (select query_id, chunk_id as id, 1 - least(vec_distance, 1.0) as rel, importance from sr where vec_distance is not null)", "m as (select query_id, greatest(max(score), 0.1) as most from t group by query_id)", "f as (select query_id, id, coalesce(t.score + coalesce(n.rel, 0) * 0.3 * m.most, n.rel * n.importance * 0.6) as score from t full join n using (query_id, id) left join m using (query_id))") + _TOP.format("score", "desc", "f").replace("round(score, 6)", f"round(score + {OFF}, 6)"),
    "short_circuit": S.with_(_SR, "n as (select query_id, (score - min(score) over w) / greatest(max(score) over w - min(score) over w, 0.001) as norm from sr window w as (partition by query_id))") + "select query_id, count(*) filter (norm >= 0.7) >= 3 and max(norm) > 0.85 as enough from n group by query_id",
    "multi_project_topk": S.with_(_SR, r"p as (select *, string_split_regex(regexp_replace(trim(file_path), '^\./', ''), '[/\\]')[1] as project from sr)", "o as (select *, row_number() over (partition by query_id, project order by score desc, chunk_id) p from p)") + "select query_id, project, chunk_id, place from (select *, row_number() over (partition by query_id order by score desc, chunk_id) place from o where p <= 3) where place <= 10",
}
