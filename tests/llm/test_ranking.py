import random

import pandas as pd
import pytest

from chunkloom.llm import ranking as R

COLUMNS = "query_id long, chunk_id long, score double, vec_distance double, fts_rank double, importance double, n int, i int, q int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], COLUMNS)


def brute(rows):
    df = pd.DataFrame(rows, columns=["q", "i", "score", "vec_distance", "fts_rank", "importance"], dtype=object).dropna(subset=["q", "i"]).drop_duplicates()
    for c in df.columns[2:]:
        df[c] = df[c].astype(float)
    out = {}
    for q, g in df.groupby("q"):
        total = 0
        for s in R.SEARCH_SCORES:
            total = total + g[s.name].rank(method="average", ascending=not s.larger_is_better).fillna((len(g) + 1) / 2)
        for i, t in zip(g.i, total):
            out[(q, i)] = t
    return out


@pytest.mark.parametrize("values", [3, 1000])
def test_against_pandas_with_ties_and_a_hot_query(spark, values):
    rng = random.Random(values)

    def v():
        return None if rng.random() < 0.2 else float(rng.randrange(values))

    rows = [(0 if k < 800 else k % 7, k, v(), v(), v(), v()) for k in range(1200)]
    rows += rows[:50] + [(None, 1, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0, 1.0), (9, 1, None, None, None, None)]
    got = {(r.query_id, r.chunk_id): r.points for r in R.borda(table(spark, rows), "query_id", "chunk_id").collect()}
    want = brute(rows)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    first = {r.query_id: r.chunk_id for r in R.first(table(spark, rows), "query_id", "chunk_id").collect()}
    assert first == {q: min((p, i) for (x, i), p in want.items() if x == q)[1] for q, _ in want}
    top = {(r.query_id, r.position): r.chunk_id for r in R.ranking(table(spark, rows), "query_id", "chunk_id", depth=5).collect()}
    order = sorted((p, i) for (x, i), p in want.items() if x == 0)
    assert [top[(0, k)] for k in range(1, 6)] == [i for _, i in order[:5]]


def test_scale_does_not_matter_and_empty(spark):
    rows = [(1, 1, 1e9, 0.1, -5.0, 0.1), (1, 2, 1.0, 0.2, -900.0, 0.9), (1, 3, 0.5, 0.3, -1.0, 0.2)]
    assert R.first(table(spark, rows), "query_id", "chunk_id").collect()[0].chunk_id == 2
    assert R.first(table(spark, []), "query_id", "chunk_id").count() == 0
