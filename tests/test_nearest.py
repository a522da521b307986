import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chunkloom.functions import embed
from chunkloom.operators import ranking
from chunkloom.plans import relations


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_close_pairs_hold_the_nearest(metric):
    """With the k-th distances so far only few pairs are looked at, and none of the nearest is lost."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, 16))
    x[100:200] = x[:100]  # equal vectors
    q, ids, own = x[:40] * 1.5, np.arange(40), np.arange(500)
    dist = 1 - q @ x.T / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)) if metric == "cosine" else np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    dist[ids, ids] = np.inf
    want = {(n, j) for n in range(40) for j in np.lexsort((own, dist[n].round(9)))[:5]}
    for last in (np.full(40, np.inf), np.sort(dist, axis=1)[:, 4].round(9)):
        row, col, far = ranking.close(ids, q, own, x, 5, metric, last)
        assert want <= set(zip(row.tolist(), col.tolist())) and len(row) <= 40 * 7
        assert np.allclose(far, dist[row, col], atol=1e-9)


def test_equal_texts_are_embedded_once(spark, data, monkeypatch):
    asked = []
    whole = embed.embedded

    def counted(rows, text, *rest):
        asked.append((rows.count(), rows.select(text).distinct().count()))
        return whole(rows, text, *rest)

    monkeypatch.setattr(embed, "embedded", counted)
    found = relations.hint_vector_knn(spark, data)
    assert found.count() > 0 and all(n == distinct for n, distinct in asked) and len(asked) == 2


def test_nearest_over_several_batches(spark):
    rows = spark.createDataFrame(pd.DataFrame({"id": range(90), "v": [[float(n % 7), float(n % 5), 1.0] for n in range(90)]})).withColumn("v", F.col("v").cast("array<double>"))
    whole = {tuple(r) for r in ranking.nearest(rows, rows, 4).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        assert {tuple(r) for r in ranking.nearest(rows, rows, 4).collect()} == whole and len(whole) == 360
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
