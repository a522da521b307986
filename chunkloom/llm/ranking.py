"""One ranking from several differently-scaled scores (problem 2): Borda count.

Each score gives competition ranks within its query, ties averaged; a row
without that score gets the mid-rank; the weighted points are summed.  Only the
order of values enters, so no score outvotes the others by its range.

Ranks are computed on the distinct (score, query, value) counts, which combine
before the shuffle.  The values of a query are spread over quantile bins and
ranked within a bin, with the bins' totals added, so a query with a third of
all rows is never one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantile bins per query and score.
BINS = 32


@dataclass(frozen=True)
class Score:
    name: str
    larger_is_better: bool = True
    weight: float = 1.0


#: The scores of search_results, each in its own good direction.
SEARCH_SCORES = (Score("score"), Score("vec_distance", False), Score("fts_rank", False), Score("importance"))


def borda(rows: DataFrame, query: str, item: str, scores: tuple[Score, ...] = SEARCH_SCORES) -> DataFrame:
    """query, item, points (lower is better) of each distinct (query, item).

    Points are the weighted sum of ranks: average rank among the rows with that
    score, (n + 1) / 2 of the query's n items for a row without it or with NaN.
    Repeated rows count once; if an item's rows differ, its best value of each
    score counts.  Rows with a null query or item are left out.  Other columns
    are not looked at.
    """
    def good(s: Score):
        value = F.col(s.name).cast("double")
        value = F.when(~F.isnan(value), value)
        return -value if s.larger_is_better else value  # ascending: best first

    items = rows.where(F.col(query).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(query).alias("q"), F.col(item).alias("i"))
    items = items.agg(*[F.min(good(s)).alias(f"v{k}") for k, s in enumerate(scores)])
    weight = F.create_map(*[F.lit(x) for k, s in enumerate(scores) for x in (k, s.weight)])
    long = items.select("q", "i", F.posexplode(F.array(*[f"v{k}" for k in range(len(scores))])).alias("k", "v"))

    counts = long.where(F.col("v").isNotNull()).groupBy("k", "q", "v").agg(F.count("*").alias("c"))
    edges = counts.groupBy("k", "q").agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], 1000).alias("edges"))
    binned = counts.join(edges, ["k", "q"]).withColumn("bin", F.size(F.filter(F.array_distinct("edges"), lambda e: e < F.col("v")))).drop("edges")
    totals = binned.groupBy("k", "q", "bin").agg(F.sum("c").alias("t"))
    earlier = Window.partitionBy("k", "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("k", "q", "bin", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("k", "q", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    local = binned.withColumn("before", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    ranks = local.join(starts, ["k", "q", "bin"]).select("k", "q", "v", (F.col("start") + F.col("before") + (F.col("c") + 1) / 2).alias("rank"))

    sizes = items.groupBy("q").agg(F.count("*").alias("n"))
    ranked = long.join(ranks, ["k", "q", "v"], "left").join(sizes, "q")
    points = F.sum(weight[F.col("k")] * F.coalesce("rank", (F.col("n") + 1) / 2))
    return ranked.groupBy("q", "i").agg(points.alias("points")).select(F.col("q").alias(query), F.col("i").alias(item), "points")


def first(rows: DataFrame, query: str, item: str, scores: tuple[Score, ...] = SEARCH_SCORES) -> DataFrame:
    """The first item of each query; equal points: the smallest identifier."""
    best = F.min(F.struct(F.round("points", 9), F.col(item)))[item]
    return borda(rows, query, item, scores).groupBy(query).agg(best.alias(item))


def ranking(rows: DataFrame, query: str, item: str, scores: tuple[Score, ...] = SEARCH_SCORES, depth: int = 10) -> DataFrame:
    """The first `depth` items of each query with their position.

    The best of each hash block come first and then the best of those, so no
    task orders all items of a query.
    """
    order = [F.round("points", 9), F.col(item)]
    points = borda(rows, query, item, scores).withColumn("block", F.pmod(F.xxhash64(item), F.lit(64)))
    part = F.row_number().over(Window.partitionBy(query, "block").orderBy(*order))
    place = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    some = points.withColumn("p", part).where(F.col("p") <= depth).drop("p", "block")
    return some.withColumn("position", place).where(F.col("position") <= depth)
