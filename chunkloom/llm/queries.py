"""Registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.common import table
from chunkloom.llm import credentials, docpairs, handwritten, leakage, ranking, tokenizer, truncation, vectors

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vectors.most_similar(table(spark, sf_dir, "chunks_vec"), "chunk_id", "embedding", dim=64, k=5, least=0.9)
    return vectors.mutual(best).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first(table(spark, sf_dir, "search_results"), "query_id", "chunk_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.findings(table(spark, sf_dir, "chunks")).where(F.col("rule") != credentials.CONTINUED)
    return found.select("chunk_id", "line_no").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select("id", "language", "content_raw")
    return credentials.redacted(chunks).select("id", "content_raw")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.found(table(spark, sf_dir, "chunks"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf_dir, "chunks")).select("chunk_id", "func_name").distinct()


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf_dir, "chunks"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encoded(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), spans=False)
    return leaks.select("doc_id", "item_id")


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("removed > 0")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(table(spark, sf_dir, "documents"))


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_redacted": p3_redacted, "p5_found": p5_found, "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_ids": p8_ids, "p9_found": p9_found, "p9_passages": p9_passages, "p9_removed": p9_removed, "p10_found": p10_found, "p10_report": p10_report}

SQL: dict[str, str] = {
    "p1_found": """with v as (select distinct chunk_id as id, embedding::double[] as e from chunks_vec where len(embedding) = 64 and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
s as (select a.id as a, b.id as b, list_cosine_similarity(a.e, b.e) as s from v a join v b on a.id <> b.id),
t as (select a, b, s from (select *, row_number() over (partition by a order by round(s, 12) desc, b) n from s) where n <= 5 and s >= 0.9)
select t.a as chunk_id_a, t.b as chunk_id_b from t join t u on u.a = t.b and u.b = t.a where t.a < t.b""",
    "p2_found": """with r as (select distinct query_id, chunk_id, score, vec_distance, fts_rank, importance from search_results),
n as (select query_id, count(*) as n from r group by 1),
l as (select query_id, chunk_id, k, v from r, lateral (values (0, -score), (1, vec_distance), (2, fts_rank), (3, -importance)) as t(k, v)),
k as (select query_id, chunk_id, rank() over w + (count(*) over (partition by query_id, k, v) - 1) / 2 as p from l where v is not null window w as (partition by query_id, k order by v)
union all select query_id, chunk_id, (n + 1) / 2 from l join n using (query_id) where v is null),
b as (select query_id, chunk_id, round(sum(p), 9) as p from k group by 1, 2)
select query_id, arg_min(chunk_id, (p, chunk_id)) as chunk_id from b group by 1""",
}
