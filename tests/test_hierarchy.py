import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chunkloom.operators import hierarchy as H


def deps(spark, edges, **more):
    rows = [(i, a, b, more.get("kind", "contains"), None) for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame(rows, "id long, source_entity long, target_entity long, dep_type string, valid_to timestamp")


def brute(edges):
    parent = {}
    nodes = set()
    for a, b in edges:
        if a is None or b is None:
            continue
        nodes |= {a, b}
        parent[b] = min(a, parent.get(b, a))
    out = {}
    for n in nodes:
        at, depth, seen = n, 0, set()
        while at in parent and at not in seen:
            seen.add(at)
            at, depth = parent[at], depth + 1
        out[n] = (-1, -1) if at in seen or at in parent else (at, depth)
    return out


def got(df):
    return {r.entity_id: (r.root_entity, r.depth) for r in df.collect()}


def test_chain_cycle_and_below(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (101, 102), (102, 103), (200, 200), (300, 301), (300, 301)]
    assert got(H.found(deps(spark, edges))) == brute(edges)


def test_null_ends_types_and_closed(spark):
    d = spark.createDataFrame([(1, 1, 2, " Contains", None), (2, 2, None, "contains", None), (3, None, 3, "contains", None), (4, 5, 6, "calls", None)], "id long, source_entity long, target_entity long, dep_type string, valid_to timestamp")
    assert got(H.found(d)) == {1: (1, 0), 2: (1, 1)}
    assert H.found(deps(spark, [])).count() == 0


def test_preorder_is_dense_and_nested(spark, monkeypatch):
    monkeypatch.setattr(H, "SIBLINGS_PER_TASK", 3)  # many blocks of siblings
    rng = random.Random(5)
    edges = [(rng.randrange(max(1, i // 4)), i) for i in range(1, 200)]
    tree = H.nested_sets(H.open_edges(deps(spark, edges)), with_path=True).collect()
    assert sorted(r.pre for r in tree) == list(range(200))
    by = {r.node: r for r in tree}
    for r in tree:
        assert r.path[-1] == r.node and len(r.path) == r.depth + 1 and r.path[0] == r.root
        for above in r.path:
            assert by[above].pre <= r.pre <= by[above]["last"]
        assert r.size == r["last"] - r.pre + 1
    some = spark.createDataFrame([(0,), (3,)], "ancestor long")
    tree_df = H.nested_sets(H.open_edges(deps(spark, edges)))
    pairs = {(r.ancestor, r.node) for r in H.descendants(tree_df, some).collect()}
    assert pairs == {(a, r.node) for r in tree for a in (0, 3) if a in r.path[:-1]}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_any_graph(spark, edges):
    assert got(H.found(deps(spark, edges))) == brute(edges)
