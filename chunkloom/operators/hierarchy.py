"""Parent-child rows to full hierarchies (problem 6).

Subtree sizes go upward, sibling preorder ranges are allocated by prefix sums
and go downward, and the nested-set ranges answer ancestor and descendant
questions.  Both directions run by pointer doubling, so a tree of depth d takes
about log2(d) rounds instead of d:

* `up` of a node is its ancestor 2^k steps above.  A node whose pointer passes
  the root is done.  A round that finishes no node is the last one, because
  depths have no gaps; nodes still unprocessed lie on a cycle or below one.
* size: the descendants within 2^(k+1) steps are those within 2^k steps, and
  those within 2^k steps of the descendants exactly 2^k steps below.
* preorder: the sum of the sibling offsets along the path to the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.common import Scratch

#: Siblings of one parent that one window task orders; more are split by hash.
SIBLINGS_PER_TASK = 10_000
#: Preorder numbers of a tree that meet the ranges of ancestors under one join key.
RANGE = 4096


def open_edges(deps: DataFrame, dep_type: str = "contains") -> DataFrame:
    """(parent, child) of the open edges of a type.

    Case and surrounding blanks of dep_type carry no meaning; valid_to null or
    9999-12-31 is open.  Edges with a null end are none.
    """
    still = F.col("valid_to").isNull() | (F.to_date("valid_to") == F.lit("9999-12-31").cast("date"))
    return (
        deps.where((F.lower(F.trim("dep_type")) == dep_type) & still)
        .select(F.col("source_entity").alias("parent"), F.col("target_entity").alias("child"))
        .where(F.col("parent").isNotNull() & F.col("child").isNotNull())
    )


def parents_of(edges: DataFrame) -> DataFrame:
    """(node, parent) for each id on either side; parent null for a root.

    Repeated edges count once.  If a node has several parents, the smallest is
    its parent; `other_parents` has the links that are not followed.
    """
    return (
        edges.select(F.col("child").alias("node"), "parent")
        .union(edges.select(F.col("parent").alias("node"), F.lit(None).cast(edges.schema["parent"].dataType)))
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
    )


def other_parents(edges: DataFrame) -> DataFrame:
    """node, parent, kept, parents of each link that a tree cannot hold, because its node hangs under another parent (`kept`)."""
    links = edges.select(F.col("child").alias("node"), "parent").distinct()
    many = links.groupBy("node").agg(F.min("parent").alias("kept"), F.count("*").alias("parents")).where("parents > 1")
    return links.join(many, "node").where("parent <> kept").select("node", "parent", "kept", "parents")


def climb(edges: DataFrame, with_path: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and root of each node, and the pointer table of each round.

    Returns (nodes, rounds): nodes has node, parent, root, depth (-1 and null
    root on or below a cycle), and `path` if asked for; rounds[k] has node, up =
    the ancestor 2^k steps above, for nodes with such an ancestor.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "hierarchy")
    base = parents_of(edges)
    first = base.select("node", "parent", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("node")).alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps"))
    if with_path:
        first = first.withColumn("path", F.array("node"))
    state = scratch.cut(first)
    rounds = []
    left = state.where(F.col("root").isNull()).count()
    while left:
        rounds.append(state.where(F.col("root").isNull()).select("node", "up"))
        above = [F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("steps").alias("steps2")]
        if with_path:
            above.append(F.col("path").alias("path2"))
        moving = state.where(F.col("root").isNull()).join(state.select(*above), "up")
        cols = ["node", "parent", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("steps") + F.col("steps2")).alias("steps")]
        if with_path:
            cols.append(F.concat("path2", "path").alias("path"))
        state = scratch.cut(state.where(F.col("root").isNotNull()).unionByName(moving.select(*cols)))
        now = state.where(F.col("root").isNull()).count()
        if now == left:
            break
        left = now
    cols = ["node", "parent", "root", F.when(F.col("root").isNull(), -1).otherwise(F.col("steps")).alias("depth")]
    if with_path:
        cols.append(F.when(F.col("root").isNotNull(), F.col("path")).alias("path"))
    return state.select(*cols), rounds


def nested_sets(edges: DataFrame, with_path: bool = False) -> DataFrame:
    """node, parent, root, depth, size, pre, last (and path) of each node.

    A node's descendants are the nodes of its root with pre in (pre, last].
    Nodes on or below a cycle have depth -1 and null in root, size, pre, last.
    An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "nested-sets")
    nodes, rounds = climb(edges, with_path)
    good = nodes.where(F.col("depth") >= 0)
    size = good.select("node", F.lit(1).cast("long").alias("size"))
    for up in rounds:  # sizes, upward
        below = up.join(size, "node").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        size = scratch.cut(size.join(below, "node", "left").select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    sized = good.join(size, "node")
    offset = scratch.cut(_sibling_offsets(sized))
    pre = offset
    for up in rounds:  # preorder numbers, downward
        above = pre.select(F.col("node").alias("up"), F.col("pre").alias("above"))
        pre = scratch.cut(pre.join(up.join(above, "up").select("node", "above"), "node", "left").select("node", (F.col("pre") + F.coalesce("above", F.lit(0))).alias("pre")))
    out = nodes.join(size, "node", "left").join(pre, "node", "left")
    return out.withColumn("last", F.col("pre") + F.col("size") - 1)


def _sibling_offsets(sized: DataFrame) -> DataFrame:
    """node, pre = 1 + the sizes of its earlier siblings (0 for a root).

    Siblings are ordered by hash block and id.  Many siblings are spread over
    as many blocks as they need, so no task holds all children of a node.
    """
    children = sized.where(F.col("parent").isNotNull()).select("node", "parent", "size")
    many = children.groupBy("parent").agg(F.ceil(F.count("*") / SIBLINGS_PER_TASK).alias("blocks"))
    placed = children.join(many, "parent").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    totals = placed.groupBy("parent", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("parent", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("parent", "block").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    offsets = own.join(starts, ["parent", "block"]).select("node", (F.lit(1) + F.col("own") + F.col("start")).alias("pre"))
    roots = sized.where(F.col("parent").isNull()).select("node", F.lit(0).cast("long").alias("pre"))
    return offsets.unionByName(roots)


def descendants(tree: DataFrame, of: DataFrame) -> DataFrame:
    """(ancestor, node) for the ids in column `ancestor` of `of`, by range within the root.

    Ranges and nodes meet in blocks of RANGE preorder numbers, so one large tree
    is as many join keys as it has blocks.  Leaves have no descendants, and ids
    on or below a cycle have none.
    """
    a = tree.join(of.select(F.col("ancestor").alias("node")).distinct(), "node", "left_semi").where((F.col("depth") >= 0) & (F.col("size") > 1))
    first, last = F.floor((F.col("pre") + 1) / RANGE), F.floor(F.col("last") / RANGE)
    a = a.select(F.col("node").alias("ancestor"), F.col("root").alias("r"), F.col("pre").alias("lo"), F.col("last").alias("hi"), F.explode(F.sequence(first, last)).alias("b"))
    inside = (F.col("root") == F.col("r")) & (F.floor(F.col("pre") / RANGE) == F.col("b")) & (F.col("pre") > F.col("lo")) & (F.col("pre") <= F.col("hi"))
    return tree.where(F.col("pre").isNotNull()).join(a, inside).select("ancestor", "node")


def found(deps: DataFrame) -> DataFrame:
    """entity_id, root_entity, depth of each id on an open `contains` edge; -1, -1 on or below a cycle."""
    tree = nested_sets(open_edges(deps))
    cyclic: Column = F.col("pre").isNull()  # never reached by the downward pass
    return tree.select(F.col("node").alias("entity_id"), F.when(cyclic, -1).otherwise(F.col("root")).alias("root_entity"), F.when(cyclic, -1).otherwise(F.col("depth")).cast("long").alias("depth"))
