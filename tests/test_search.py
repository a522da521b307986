import pytest
from pyspark.sql import functions as F

from chunkloom.common import table
from chunkloom.operators import entities, search
from chunkloom.operators.chunks import live

CHUNKS = "id long, file_path string, name string, chunk_type string, importance double"


@pytest.fixture(scope="module")
def folders(spark):
    rows = [(1, "src/auth/a.py", "login_user", "function", 0.9), (2, "src/auth/b.py", "Token", "class", 0.8), (3, "src/db.py", "find", "function", 0.7), (4, "src/authority.py", "x", "import", 0.3), (5, "", "auth", "function", 0.9)]
    return spark.createDataFrame(rows, CHUNKS)


def test_communities_match_path_and_summary(spark, folders):
    texts = entities.community_texts(folders)
    by = {r.path: (r.chunk_count, r.text) for r in texts.collect()}
    assert by["src/auth"] == (2, "src/auth\n**auth** — 1 class, 1 function. key items: login_user, token")
    assert by["src/authority.py"] == (1, "src/authority.py") and "" not in by
    asked = spark.createDataFrame([(1, "auth/"), (2, "Find"), (3, "1 class"), (4, "nowhere"), (5, "AUTH")], "query_id long, text string")
    got = {}
    for r in entities.matching_communities(texts, asked).collect():
        got.setdefault(r.query_id, set()).add(r.path)
    assert got == {1: {"src/auth/a.py", "src/auth/b.py"}, 2: {"src", "src/db.py"}, 3: {"src", "src/auth", "src/auth/b.py"}, 5: {"src/auth", "src/auth/a.py", "src/auth/b.py"}}


def test_community_members_by_prefix(folders):
    paths = folders.sparkSession.createDataFrame([("src/auth",), ("src/db.py",)], "path string")
    out = entities.community_chunks(folders, paths, 10, F.col("file_path")).collect()
    assert {(r.path, r.id) for r in out} == {("src/auth", 1), ("src/auth", 2), ("src/db.py", 3)}


def test_layered_brings_in_communities(spark, data):
    t = [table(spark, data, n).limit(0) for n in ("entities", "entity_attributes", "entity_dependencies", "chunks_vec")]
    rows = live(table(spark, data, "chunks"))
    asked = spark.createDataFrame([(-1, "emory/")], "query_id long, text string")
    out = search.layered(rows, asked, *t, F.lit("2026-01-01").cast("timestamp")).collect()
    members = sorted((-r.importance, r.id) for r in rows.where(F.col("file_path").startswith("memory/")).collect())
    assert [(r.id, r.layers) for r in sorted(out, key=lambda r: r.place)] == [(i, "community") for _, i in members[:10]]
    assert [r.score for r in sorted(out, key=lambda r: r.place)] == [pytest.approx(0.15 * -m * (0.95 - 0.05 * m), abs=1e-6) for m, _ in members[:10]]
