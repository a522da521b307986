import pytest

from chunkloom.plans import graph

DEPS = "id long, source_entity long, target_entity long, dep_type string, valid_from timestamp, valid_to timestamp"


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("deps"))
    rows = [(1, 20, 1, "contains", None, None), (2, 1, 2, "calls", None, None), (3, 7, 40, " Contains", None, None)]
    spark.createDataFrame(rows, DEPS).write.parquet(f"{folder}/entity_dependencies.parquet")
    return folder


def test_closure_follows_containers(spark, linked):
    got = {(r.origin, r.node, r.depth) for r in graph.QUERIES["entity_closure_all"](spark, linked).collect()}
    assert got == {(20, 1, 1), (20, 2, 2)}


def test_neighbourhood_of_every_twentieth(spark, linked):
    got = {(r.origin, r.depth, r.nodes) for r in graph.QUERIES["graph_neighbourhood_all"](spark, linked).collect()}
    assert got == {(20, 1, 1), (20, 2, 1), (40, 1, 1)}


def test_context_two_hops(spark, tmp_path):
    entities = [(i, i) for i in (20, 21, 22, 23)]
    spark.createDataFrame(entities, "id long, chunk_id long").write.parquet(f"{tmp_path}/entities.parquet")
    rows = [(1, 20, 21, "calls", None, None), (2, 21, 22, "calls", None, None), (3, 22, 23, "calls", None, None)]
    spark.createDataFrame(rows, DEPS).write.parquet(f"{tmp_path}/entity_dependencies.parquet")
    at = "2025-01-01 00:00:00"
    rows = [(i, 0.5, False, at, at) for i in (20, 21, 22, 23)]
    chunks = spark.createDataFrame(rows, "id long, importance double, is_deleted boolean, created_at string, updated_at string")
    chunks.withColumns({c: chunks[c].cast("timestamp") for c in ("created_at", "updated_at")}).write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.id for r in graph.QUERIES["context_expand_full"](spark, str(tmp_path)).collect()}
    assert got == {21, 22, 23}
