"""Scoring after retrieval: diversity, budgets, fusion, nearest vectors, quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import scalar
from chunkloom.operators.fulltext import top

#: Factor for each further result of one source; queries compared at once.
REPEAT = 0.85
QUERY_BLOCK = 512
#: Bytes of queries that are broadcast for one reading of the vectors.
QUERY_BYTES = 256 << 20


def dampen(rows: DataFrame, by: str = "query_id", score: str = "score", key: Column | None = None, ident: str = "id") -> DataFrame:
    """Rows with the n-th result of a source (in score order) times 0.85^(n-1).

    Unchanged where a query has a single source.  Equal scores: smaller id first.
    """
    key = key if key is not None else scalar.source_key(F.col("name"), F.col("file_path"))
    keyed = rows.withColumn("_key", F.coalesce(key, F.lit("")))
    order = [F.desc(F.round(score, 9)), F.col(ident)]
    nth = F.row_number().over(Window.partitionBy(by, "_key").orderBy(*order))
    whole = Window.partitionBy(by)
    several = F.min("_key").over(whole) != F.max("_key").over(whole)
    factor = F.when(several, F.pow(F.lit(REPEAT), nth - 1)).otherwise(1.0)
    return keyed.withColumn("_factor", factor).withColumn(score, F.col(score) * F.col("_factor")).drop("_key", "_factor")


def within_budget(rows: DataFrame, budget: int, tokens: str = "tokens", by: str = "query_id", *order: Column) -> DataFrame:
    """The rows of each query, in order, until the first that overflows the budget; the first row always stays."""
    w = Window.partitionBy(by).orderBy(*order)
    out = rows.withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    over = F.min(F.when((F.col("used") > budget) & (F.col("place") > 1), F.col("place"))).over(Window.partitionBy(by))
    return out.withColumn("_over", over).where(F.col("_over").isNull() | (F.col("place") < F.col("_over"))).drop("_over")


def close(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int, metric: str, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of x and distance of all pairs that may be among a query's k nearest, given its k-th distance so far.

    Cosines are first taken in single precision; what is near by more than its error is taken again in double.
    """
    slack, exact = 2e-9, True
    with np.errstate(all="ignore"):
        if metric == "cosine":
            lq, lx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
            exact = not (np.isfinite(lq).all() and np.isfinite(lx).all() and lq.all() and lx.all())
            if exact:
                d = 1 - (q @ x.T) / (lq[:, None] * lx[None, :])
                d[~np.isfinite(d)] = np.inf
            else:
                d = (q / -lq[:, None]).astype(np.float32) @ (x / lx[:, None]).astype(np.float32).T
                d += np.float32(1)
                slack = (q.shape[1] + 8) * 1.2e-7 + 2e-9
        else:
            d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0))
            d[~np.isfinite(d)] = np.inf
    at = np.argsort(ids, kind="stable")
    there = np.flatnonzero(np.isin(own, ids))
    d[at[np.searchsorted(ids[at], own[there])], there] = np.inf
    limit = last + slack
    if len(own) > k and not np.isfinite(last).all():
        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * slack)
    row, col = np.nonzero(d <= limit.astype(d.dtype)[:, None] + d.dtype.type(slack))
    far = d[row, col]
    row, col, far = row[np.isfinite(far)], col[np.isfinite(far)], far[np.isfinite(far)]
    if not exact:
        # a part at a time, since very many may be equally near
        parts = [1 - np.einsum("ij,ij->i", q[row[s : s + 65536]], x[col[s : s + 65536]]) / (lq[row[s : s + 65536]] * lx[col[s : s + 65536]]) for s in range(0, len(row), 65536)]
        far = np.concatenate(parts) if parts else np.zeros(0)
    return row, col, far


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", vector: str = "v") -> DataFrame:
    """query_id, id, distance of the k nearest vectors of each query, exactly; the query's own id is left out.

    Both tables have `id_col` and an array `vector`.  The stated queries go
    against all rows in blocks: each task compares its rows with a block of the
    queries and keeps its best k of all its rows, so a shuffled row is a candidate of one task.
    Vectors of other lengths, null, zero (for cosine) or not finite are skipped.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))).groupBy(F.col(id_col).alias("id")).agg(F.min(vector).alias("v"))

    def blocks(asked: list) -> list[tuple[np.ndarray, np.ndarray]]:
        by_size: dict[int, list] = {}
        for r in asked:
            by_size.setdefault(len(r["v"]), []).append(r)
        return [(np.array([r["id"] for r in rows[s : s + QUERY_BLOCK]], np.int64), np.array([r["v"] for r in rows[s : s + QUERY_BLOCK]], np.float64)) for rows in by_size.values() for s in range(0, len(rows), QUERY_BLOCK)]

    def run(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
        state = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in shared.value]  # row, id and distance of the nearest so far
        last = [np.full(len(ids), np.inf) for ids, _ in shared.value]  # of each query the k-th distance so far
        for pdf in batches:
            sizes = pdf.v.map(len).to_numpy()
            of_size = {n: (pdf.id.to_numpy()[sizes == n], np.stack(pdf.v.to_numpy()[sizes == n]).astype(np.float64)) for n in np.unique(sizes)}
            for n, (ids, q) in enumerate(shared.value):
                if q.shape[1] in of_size:
                    own, x = of_size[q.shape[1]]
                    row, col, d = close(ids, q, own, x, k, metric, last[n])
                    if len(row):
                        row, found, d = (np.concatenate(y) for y in zip(state[n], (row, own[col], d)))
                        order = np.lexsort((found, d.round(9), row))
                        row, found, d = row[order], found[order], d[order]
                        nth = np.arange(len(row)) - np.searchsorted(row, row)
                        state[n] = tuple(y[nth < k] for y in (row, found, d))
                        last[n][row[nth == k - 1]] = d[nth == k - 1].round(9)
        for (ids, _), (row, found, d) in zip(shared.value, state):
            if len(row):
                yield pd.DataFrame({"query_id": ids[row], "id": found, "distance": d})

    schema = "query_id long, id long, distance double"
    found = spark.createDataFrame([], schema)
    asked, rows = clean(queries), clean(vectors)
    size = asked.agg(F.sum(F.size("v") + 2)).first()[0] or 0
    rounds = -(-size * 8 // QUERY_BYTES)  # the queries of one round fit the driver and a broadcast
    for n in range(rounds):
        shared = spark.sparkContext.broadcast(blocks(asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == n).collect()))
        found = found.unionByName(rows.mapInPandas(lambda batches, shared=shared: run(batches, shared), schema))
    return top(found, k, F.round("distance", 9), F.col("id")).drop("place")


def add_vector_layer(results: DataFrame, near: DataFrame, existing: float = 0.3, fresh: float = 0.6) -> DataFrame:
    """Results (query_id, id, score) with a vector layer (query_id, id, distance, weight) folded in.

    Rows already there gain relevance * existing * the greatest score of the
    query (0.1 at least); others come in with relevance * weight * fresh.
    Relevance is 1 - distance, 0 from distance 1 on.
    """
    most = results.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(0.1)).alias("most"))
    both = results.select("query_id", "id", "score").join(near, ["query_id", "id"], "full_outer").join(most, "query_id", "left")
    relevance = F.coalesce(1 - F.least("distance", F.lit(1.0)), F.lit(0.0))
    gained = F.col("score") + relevance * existing * F.col("most")
    return both.select("query_id", "id", F.coalesce(gained, relevance * F.col("weight") * fresh).alias("score"))


def gravity(rows: DataFrame, spread: float, by: str = "query_id", score: str = "score") -> DataFrame:
    """Rows with each score pulled to its query's mean; spread 1 leaves it, 0 makes all equal."""
    mean = F.avg(score).over(Window.partitionBy(by))
    return rows.withColumn(score, mean + (F.col(score) - mean) * spread)


def layers_hit(rows: DataFrame, layers: str = "layers") -> DataFrame:
    """layer, n: in how many results each layer took part (an array column)."""
    return rows.select(F.explode(layers).alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))


def quality(ranked: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """queries, hit_k for each k, and mrr of ranked (query_id, id, place) against truth (query_id, id), for each group of truth's columns `by`."""
    first = truth.join(ranked, ["query_id", "id"], "left").groupBy("query_id", *by).agg(F.min("place").alias("first"))
    hits = [F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"hit_{k}") for k in at]
    return first.groupBy(*by).agg(F.count("*").alias("queries"), *hits, F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
