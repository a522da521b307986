import random

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import blocks, fulltext

ROWS = "id long, name string, signature string, content_raw string, file_path string"


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(5)
    words = [f"w{n}" for n in range(40)]

    def text(most):
        return " ".join(draw.choices(words, [1 / (n + 1) for n in range(40)], k=draw.randint(0, most))) or None

    rows = [(i, text(2), text(3), text(30), text(2)) for i in range(300)]
    rows += [(1000 + i, *rows[i % 50][1:]) for i in range(300)]  # equal rows, so equal scores
    asked = [(n, draw.sample(words, draw.randint(1, 4))) for n in range(60)] + [(90, []), (91, ["nowhere"]), (92, ["w1", "w1", "w30"])]
    return spark.createDataFrame(rows, ROWS).repartition(5).localCheckpoint(), spark.createDataFrame(asked, "query_id long, terms array<string>")


@pytest.mark.parametrize("by", ["rank", "weighted"])
@pytest.mark.parametrize("k", [3, 40])
def test_best_is_what_sorting_all_hits_gives(spark, monkeypatch, texts, by, k):
    rows, queries = texts
    want = fulltext.top(fulltext.bm25(fulltext.index(rows), queries), k, F.round(by, 9), F.col("id")).collect()
    monkeypatch.setattr(fulltext, "ROUND", 25)
    got = fulltext.top(fulltext.best(rows, queries, k, by=by), k, F.round(by, 9), F.col("id")).collect()
    values = lambda found: {(r.query_id, r.place): (r.id, round(r["rank"], 7), round(r.weighted, 7)) for r in found}
    assert values(got) == values(want) and len(want) > 60


@pytest.mark.parametrize("k", [2, 30])
def test_blocks_of_any_size(monkeypatch, texts, k):
    rows, queries = texts
    code = {f"w{n}": n for n in range(40)}
    pdf = rows.select("id", F.col("id").alias("tie"), *[F.coalesce(f, F.lit("")).alias(f"f{n}") for n, f in enumerate(fulltext.FIELDS)]).toPandas()
    asked = [(r.query_id, [code[t] for t in dict.fromkeys(r.terms) if t in code]) for r in queries.collect()]
    asked = [(q, blocks.np.array(t)) for q, t in asked if t]

    def run(size):
        cut = [blocks.cut(pdf[n : n + size].reset_index(drop=True), code, list(fulltext.FIELDS.values())) for n in range(0, len(pdf), size)]
        idf = 5 / (1 + blocks.np.arange(40.0))
        parts = blocks.best(blocks.merged(iter([blocks.pd.DataFrame([c]) for c in cut]), idf, 20.0, 1.2, 0.75), asked, k, "heavy")
        return {tuple(x) for p in parts for x in p.round(9).to_numpy().tolist()}

    whole = run(1000)
    monkeypatch.setattr(blocks, "FIRST_ROWS", 20)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 60)
    monkeypatch.setattr(blocks, "LONGER", 1)
    monkeypatch.setattr(blocks, "OUT_ROWS", 7)
    assert run(17) == whole


def test_few_rows_leave_a_task(texts):
    """Common terms hit nearly every row; without a bound each hit was shuffled."""
    rows, queries = texts
    hits = fulltext.bm25(fulltext.index(rows), queries).count()
    found = fulltext.best(rows, queries, 3)
    assert found.count() <= 62 * 3 * found.rdd.getNumPartitions() and hits > 10_000


def test_queries_of_the_same_words_ask_once(spark):
    queries = spark.createDataFrame([(7, "b a"), (3, "b  A"), (5, "a b"), (9, "")], "query_id long, text string")
    every = fulltext.asked(queries)
    assert {(r.query_id, tuple(r.terms)) for r in fulltext.asking(every).collect()} == {(3, ("b", "a")), (5, ("a", "b")), (9, ())}
    found = spark.createDataFrame([(3, 1), (3, 2), (5, 4)], "query_id long, id long")
    assert {tuple(r) for r in fulltext.answered(every, found).collect()} == {(3, 1), (3, 2), (7, 1), (7, 2), (5, 4)}


def test_hint_search_ties_go_by_chunk_then_text(spark, monkeypatch):
    from chunkloom.operators import search

    monkeypatch.setattr(fulltext, "bm25", None)  # no row for each hit
    hints = spark.createDataFrame([(n, f"{w} queue", "symbol") for n in range(30) for w in ("how", "who")] + [(n, "other words", "symbol") for n in range(90)], "chunk_id long, hint_text string, hint_type string")
    queries = spark.createDataFrame([(1, "queue"), (2, "Queue"), (3, "how")], "query_id long, text string")
    got = {(r.query_id, r.id) for r in search.hint_search(hints.repartition(3), queries, 2).collect()}
    assert got == {(q, n) for q in (1, 2, 3) for n in (0, 1)}


def test_plans_do_not_list_all_hits(spark, data, monkeypatch):
    from chunkloom.plans import search

    monkeypatch.setattr(fulltext, "bm25", None)
    for name in ("fts_bm25_topk", "fts_weighted_columns", "fts_normalized", "content_search", "search_dampened", "name_match_bonus", "eval_hit_at_k_mrr"):
        assert search.QUERIES[name](spark, data).count() > 0, name
