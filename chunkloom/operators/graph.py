"""The labelled graph over chunks and entities: closures, boosts, importance and derived edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.common import Scratch
from chunkloom.functions import scalar
from chunkloom.operators.fulltext import answered, top

#: Score of a context chunk by the edge that reached it; what opens a container and what it may hold.
EDGE_SCORES = {"calls": 0.9, "imports": 0.7, "extends": 0.6, "implements": 0.6, "overrides": 0.55, "contains": 0.4, "references": 0.35}
ENTITY_SCORE = 0.3
CONTAINERS = ("class", "impl", "trait", "module", "enum", "struct")
MEMBERS = ("method", "constant", "type")


def dep_type(c: Column) -> Column:
    """A dependency type, cleanly written."""
    return F.lower(F.trim(c))


def is_open(valid_to: Column) -> Column:
    """Whether an edge is open: valid_to null or the far date."""
    return valid_to.isNull() | (F.to_date(valid_to) == F.lit("9999-12-31").cast("date"))


def entity_edges(deps: DataFrame, open_only: bool = True) -> DataFrame:
    """Distinct (src, dst, rel_type) of entity dependencies; edges with a null end are none."""
    rows = deps.where(is_open(F.col("valid_to"))) if open_only else deps
    return rows.select(F.col("source_entity").alias("src"), F.col("target_entity").alias("dst"), dep_type(F.col("dep_type")).alias("rel_type")).dropna().distinct()


def materialise(deps: DataFrame, entities: DataFrame) -> DataFrame:
    """Chunk edges (src, dst, rel_type) of the open dependencies between entities that have different chunks."""
    e = entities.where(F.col("chunk_id").isNotNull()).select("id", "chunk_id")
    a, b = e.select(F.col("id").alias("src"), F.col("chunk_id").alias("a")), e.select(F.col("id").alias("dst"), F.col("chunk_id").alias("b"))
    return entity_edges(deps).join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "rel_type").distinct()


def reached(edges: DataFrame, seeds: DataFrame, hops: int, include_seeds: bool = False) -> DataFrame:
    """origin, node, depth: the least number of hops (<= hops) from each seed along src -> dst.

    A seed (column node) is its own origin unless it has a column `origin`; seeds
    of one origin are searched from together.  Breadth-first: each round joins
    only the nodes reached last; one aggregate keeps the least depth of each
    node, and the state is written to the shared folder.
    """
    scratch = Scratch(seeds.sparkSession, "reached")
    step = scratch.cut(edges.select("src", "dst").distinct())
    origin = F.col("origin" if "origin" in seeds.columns else "node").alias("origin")
    state = scratch.cut(seeds.select(origin, "node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        front = state.where(F.col("depth") == depth - 1)
        new = front.join(step, front.node == step.src).select("origin", F.col("dst").alias("node"), F.lit(depth).alias("depth"))
        state = scratch.cut(state.unionByName(new).groupBy("origin", "node").agg(F.min("depth").alias("depth")))
    return state if include_seeds else state.where("depth > 0")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def seed_entities(entities: DataFrame, queries: DataFrame, per_token: int = 5, most: int = 20) -> DataFrame:
    """query_id, node: entities whose canonical name contains a query token, the most mentioned of each token, those of lowest id of a query."""
    tokens = queries.select("query_id", F.explode(F.array_distinct(F.filter(scalar.tokens(F.col("text")), lambda t: F.octet_length(t) >= 2))).alias("token"))
    words = tokens.select("token").distinct()
    # a name that contains a token holds the token's first letters: an equal join finds the few to look at
    key = words.withColumn("gram", F.substring("token", 1, 3))
    starts = F.sequence(F.lit(1), F.length("canonical_name"))
    grams = F.array_distinct(F.concat(*[F.transform(starts, lambda i: F.substring(F.col("canonical_name"), i, F.lit(2))), F.transform(starts, lambda i: F.substring(F.col("canonical_name"), i, F.lit(3)))]))
    names = entities.where(F.length("canonical_name") > 0).select("id", "canonical_name", "mentions", F.explode(grams).alias("gram"))
    matched = names.join(key, "gram").where(F.contains("canonical_name", F.col("token"))).drop("gram")
    best = top(matched, per_token, F.desc("mentions"), F.col("id"), by="token")
    both = tokens.join(best, "token").select("query_id", F.col("id").alias("node")).distinct()
    return top(both, most, F.col("node")).drop("place")


def graph_boost(entities: DataFrame, deps: DataFrame, attributes: DataFrame, queries: DataFrame, k: int = 50, hops: int = 3) -> DataFrame:
    """query_id, id, score: 0.2 * 0.5^hops of the chunks of entities near the query's seed entities."""
    scratch = Scratch(queries.sparkSession, "boost")
    # queries of one text ask together, by the smallest query_id
    every = scratch.cut(queries.select("query_id", "text", F.min("query_id").over(Window.partitionBy("text")).alias("asks")))
    own = entities.where(F.col("chunk_id").isNotNull()).select(F.col("id").alias("node"), "chunk_id")
    linked = attributes.where(F.col("chunk_id").isNotNull() & (F.col("chunk_id") != -1)).select(F.col("entity_id").alias("node"), "chunk_id")
    chunks = scratch.cut(own.unionByName(linked).distinct().select("node", F.col("chunk_id").alias("id")))
    step = scratch.cut(undirected(entity_edges(deps)))
    # chunks of a node's neighbours: twice k are enough, since a query that needs more has fewer than k, which may be among them
    beside = scratch.cut(top(step.join(chunks, step.dst == chunks.node).select(F.col("src").alias("node"), "id").distinct(), 2 * k, F.col("id"), by="node").drop("place"))

    def nearest(found: DataFrame) -> DataFrame:
        return scratch.cut(top(found.groupBy("query_id", "id").agg(F.min("depth").alias("depth")), k, F.col("depth"), F.col("id")).drop("place"))

    def short(nodes: DataFrame, found: DataFrame) -> DataFrame:
        return nodes.join(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "query_id", "left_anti")

    front = seen = scratch.cut(seed_entities(entities, every.where("query_id = asks").select("query_id", "text")).select("query_id", "node"))
    found = nearest(front.join(chunks, "node").select("query_id", "id", F.lit(0).alias("depth")))
    for depth in range(1, hops + 1):
        # deeper chunks score less, so a query that has k needs none of them
        near = short(front, found).join(beside, "node").select("query_id", "id", F.lit(depth).alias("depth"))
        found = nearest(found.unionByName(near))
        if depth < hops:
            ahead = short(front, found).join(step, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node")).distinct()
            front = scratch.cut(ahead.join(seen, ["query_id", "node"], "left_anti"))
            seen = seen.unionByName(front)
    return answered(every, found.select("query_id", "id", (F.lit(0.2) * F.pow(F.lit(0.5), F.col("depth"))).alias("score")))


def boost_ids(entities: DataFrame, deps: DataFrame, attributes: DataFrame, queries: DataFrame, most: int = 50) -> DataFrame:
    """query_id, id: chunks of the attributes of a query's entities and of their neighbours, the smallest ids.

    A query's entities are those whose canonical name contains one of its
    tokens: of the 100 most mentioned the 20 of smallest id.  Neighbours are
    those of any edge, closed ones too, in either direction.
    """
    seeds = seed_entities(entities, queries, per_token=100, most=100)
    named = seeds.join(entities.select(F.col("id").alias("node"), "mentions"), "node")
    some = top(top(named, 100, F.desc("mentions"), F.col("node")).drop("place"), 20, F.col("node")).select("query_id", "node")
    beside = some.join(undirected(entity_edges(deps, open_only=False)), F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node"))
    linked = attributes.where(F.col("chunk_id").isNotNull()).select(F.col("entity_id").alias("node"), F.col("chunk_id").alias("id"))
    return top(some.union(beside).distinct().join(linked, "node").select("query_id", "id").distinct(), most, F.col("id")).select("query_id", "id")


def importance(chunks: DataFrame, edges: DataFrame, constrained: DataFrame) -> DataFrame:
    """id, importance from a chunk's base importance, its incoming imports and calls, what it contains and constraints on it.

    clamp(base * (0.3 + 0.3 log10(1+in) + 0.2 log10(1+contains) + 0.2 constrained), 0.1, 1).
    `constrained` has the ids of chunks with a constraint.
    """
    into = edges.where(F.col("rel_type").isin("imports", "calls")).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("into"))
    holds = edges.where(F.col("rel_type") == "contains").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("holds"))
    bound = constrained.select("id").distinct().withColumn("bound", F.lit(1.0))
    out = chunks.select("id", "importance").join(into, "id", "left").join(holds, "id", "left").join(bound, "id", "left")
    zero = F.lit(0.0)
    raw = F.col("importance") * (0.3 + 0.3 * F.log10(1 + F.coalesce("into", zero)) + 0.2 * F.log10(1 + F.coalesce("holds", zero)) + 0.2 * F.coalesce("bound", zero))
    return out.select("id", F.least(F.greatest(raw, F.lit(0.1)), F.lit(1.0)).alias("importance"))


def contains_edges(chunks: DataFrame) -> DataFrame:
    """src, dst: each member chunk and the last container before it in its file, if its lines lie inside."""
    w = Window.partitionBy("file_path").orderBy("line_start", "id").rowsBetween(Window.unboundedPreceding, -1)
    box = F.when(F.col("chunk_type").isin(*CONTAINERS), F.struct(F.col("id"), F.col("line_start").alias("lo"), F.col("line_end").alias("hi")))
    # other chunks take no part, so a path that holds very many notes is no large group here
    some = chunks.where(F.col("chunk_type").isin(*CONTAINERS, *MEMBERS))
    last = some.withColumn("box", F.last(box, ignorenulls=True).over(w))
    inside = (F.col("line_start") > F.col("box.lo")) & (F.col("line_end") <= F.col("box.hi"))
    return last.where(F.col("chunk_type").isin(*MEMBERS) & inside).select(F.col("box.id").alias("src"), F.col("id").alias("dst"))


def overrides(deps: DataFrame, entities: DataFrame) -> DataFrame:
    """src, dst: methods of a class and equally named methods of the class it extends."""
    edges = entity_edges(deps)
    named = entities.where(F.col("entity_type") == "method").select(F.col("id").alias("m"), F.regexp_replace("canonical_name", r"#\d+$", "").alias("n"))
    holds = edges.where(F.col("rel_type") == "contains").select(F.col("src").alias("c"), F.col("dst").alias("m")).join(named, "m")
    child = holds.select(F.col("c").alias("child"), F.col("m").alias("src"), "n")
    parent = holds.select(F.col("c").alias("parent"), F.col("m").alias("dst"), "n")
    extends = edges.where(F.col("rel_type") == "extends").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    return extends.join(child, "child").join(parent, ["parent", "n"]).select("src", "dst").distinct()


def context(edges: DataFrame, entity_near: DataFrame, seeds: DataFrame, chunks: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """query_id, id, score: chunks to show beside the seeds (query_id, node).

    Forward over the scored edge types up to `depth` hops, from there backward
    over calls and contains, and one hop over entities (edges src, dst).  A
    chunk's score is that of its best edge; ties by importance, then id.
    """
    scored = edges.where(F.col("rel_type").isin(*EDGE_SCORES)).select("src", "dst", "rel_type")
    origin = seeds.select("query_id", F.col("node").alias("origin"))
    near = origin.join(reached(scored, seeds, depth, include_seeds=True), "origin").select("query_id", "node").distinct()
    weight = scalar._lookup(EDGE_SCORES, F.col("rel_type"))
    ahead = near.join(scored, near.node == scored.src).select("query_id", F.col("dst").alias("id"), weight.alias("score"))
    back = scored.where(F.col("rel_type").isin("calls", "contains"))
    behind = near.join(back, near.node == back.dst).select("query_id", F.col("src").alias("id"), weight.alias("score"))
    both = entity_near.select("src", "dst").union(entity_near.select("dst", "src"))
    beside = seeds.join(both, seeds.node == both.src).select("query_id", F.col("dst").alias("id"), F.lit(ENTITY_SCORE).alias("score"))
    best = ahead.unionByName(behind).unionByName(beside).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    fresh = best.join(seeds.select("query_id", F.col("node").alias("id")), ["query_id", "id"], "left_anti")
    return top(fresh.join(chunks.select("id", "importance"), "id"), most, F.desc("score"), F.desc("importance"), F.col("id")).select("query_id", "id", "score")
