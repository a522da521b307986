import json
import os

import pytest

from chunkloom.engine import Engine, Plugins, QueryCache, across
from chunkloom.operators import chunks as C
from chunkloom.operators import entities, fulltext, graph, ranking
from chunkloom.sources import chunkers, files
from chunkloom.sources.store import Store
from chunkloom.streaming import changes, events
from pyspark.sql import functions as F


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_index_search_change_and_delete(spark, tmp_path):
    root, place = str(tmp_path / "src"), str(tmp_path / "store")
    write(root, "a/auth.py", "def login(user):\n    return find(user)\n\ndef logout():\n    pass\n")
    write(root, "a/db.py", "def find(user):\n    return user\n")
    write(root, "node_modules/x.py", "def hidden():\n    pass\n")
    write(root, ".git/y.py", "def hidden():\n    pass\n")
    write(root, "skip/z.py", "def ignored():\n    pass\n")
    engine = Engine(spark, place)
    assert engine.index(root, ["skip/"]) == {"added": 2}
    assert [r.name for r in engine.search("login", 3).collect()][0] == "login"
    assert {r.name for r in engine.search("function", 5, path="a/db.py").collect()} <= {"find"}
    deps = {(r.way, r.name) for r in engine.deps("a/auth.py").collect()}
    assert ("calls", "find") in deps
    assert engine.get("a/db.py", 1).first().name == "find"
    write(root, "a/db.py", "def lookup(user):\n    return user\n")
    os.remove(os.path.join(root, "a/auth.py"))
    assert engine.index(root, ["skip/"]) == {"updated": 1, "removed": 1}
    assert {r.name for r in engine.chunks().collect()} == {"lookup"}
    assert engine.call("search", query="lookup")["result"][0]["name"] == "lookup"
    assert engine.call("nothing")["ok"] is False and engine.call("get", wrong=1)["ok"] is False
    json.dumps(engine.call("ls"), default=str)
    assert engine.context("lookup", max_tokens=1).count() == 1
    other = Engine(spark, str(tmp_path / "other"))
    assert other.ingest([{"content": "the lookup is slow", "chunk_type": "fact", "source_type": "memory", "importance": 0.2}] * 2) == 1
    assert other.ingest([{"content": "the lookup is slow", "chunk_type": "fact", "source_type": "memory", "importance": 0.9}]) == 0
    row = other.chunks().first()
    assert row.importance == 0.9
    assert across({"a": engine, "b": other}, "lookup").count() == 2
    other.forget([row.id])
    assert other.chunks().count() == 0


def test_plugins(spark, tmp_path):
    write(str(tmp_path / "s"), "a.py", "def alpha():\n    pass\n\ndef beta():\n    pass\n")
    p = Plugins(pre_search=[lambda q: q.withColumn("text", F.lit("beta"))], layers=[lambda rows, q: rows.where("name = 'alpha'").select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(9.0).alias("score"))])
    e = Engine(spark, str(tmp_path / "i"), p)
    e.index(str(tmp_path / "s"))
    assert [r.name for r in e.search("zzz").collect()] == ["alpha", "beta"]


def test_cache():
    now = [0.0]
    c = QueryCache(10, 2, lambda: now[0])
    c.put("a", 1), c.put("b", 2), c.put("c", 3)
    assert (c.get("a"), c.get("b"), c.get("c")) == (None, 2, 3)
    now[0] = 11
    assert c.get("b") is None


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s.replace("t", df)
    old = s.read("t")
    s.upsert("t", spark.createDataFrame([(2, "c", 1)], "k int, v string, extra int"), "k")
    assert {(r.k, r.v) for r in s.read("t").collect()} == {(1, "a"), (2, "c")} and old.count() == 2
    s.insert_ignore("t", spark.createDataFrame([(1, "z"), (3, "d"), (3, "d")], "k int, v string"), "k")
    assert s.read("t").count() == 3
    s.delete("t", spark.createDataFrame([(1,)], "k int"), "k")
    s.compact("t", 1)
    assert s.statistics("t")["rows"] == 2 and s.statistics("t")["files"] == 1
    assert s.vacuum("t") == 4 and s.versions("t") == [5]
    with pytest.raises(ValueError):
        s.reset()
    s.reset(confirm=True)
    assert not s.exists("t")


def test_stream_equals_batch(spark, tmp_path):
    log, store = str(tmp_path / "log"), Store(spark, str(tmp_path / "store"))
    os.makedirs(log)

    def cut(rows):
        return chunkers.chunks(rows.select("path", F.lit("python").alias("language"), "content"))

    def push(n, rows):
        with open(f"{log}/.{n}", "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows))
        os.rename(f"{log}/.{n}", f"{log}/{n}.json")
        changes.start(spark, log, store, cut, str(tmp_path / "cp"), once=True).awaitTermination()

    a = {"path": "a.py", "kind": "added", "at": "2025-01-01T00:00:00Z", "content": "def one():\n    pass\n"}
    push(1, [a, {**a, "kind": "modified", "at": "2025-01-01T00:00:01Z", "content": "def two():\n    pass\n"}, {**a, "path": "b.py"}, {**a, "path": "c.unknown"}])
    push(2, [{**a, "kind": "deleted", "at": "2025-01-01T00:00:02Z", "content": None}])
    rows = store.read("chunks").collect()
    assert {(r.file_path, r.name, r.is_deleted) for r in rows} == {("a.py", "two", True), ("b.py", "one", False)}
    assert store.read("episodes").count() == 3


def test_windows_over_a_stream(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    os.makedirs(tmp_path / "in")
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream, "1 hour", watermark="40 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type, r.n) for r in spark.table("w").collect()}
    assert got == {(r.start, r.event_type, r.n) for r in events.tumbling(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").collect()}
    q = events.first_of_kind(stream, "user_id", "event_type", watermark="40 days").writeStream.format("memory").queryName("d").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("d").count() == batch.select("user_id", "event_type").distinct().count()


def test_bm25_formula(spark):
    import math

    df = spark.createDataFrame([(1, "login", "fn login", "login db", "a"), (2, None, None, "logout session", "b"), (3, "x", "y", "z", "c")], "id long, name string, signature string, content_raw string, file_path string")
    q = spark.createDataFrame([(0, ["login"])], "query_id long, terms array<string>")
    r = fulltext.bm25(fulltext.index(df), q).collect()
    n, mean, length = 3, (6 + 3 + 4) / 3, 6
    idf = math.log((n - 1 + 0.5) / 1.5)
    norm = 1.2 * (0.25 + 0.75 * length / mean)
    assert len(r) == 1 and abs(r[0]["rank"] + idf * 3 * 2.2 / (3 + norm)) < 1e-12
    assert abs(r[0]["weighted"] + idf * 16 * 2.2 / (16 + norm)) < 1e-12


def test_dampening_and_budget(spark):
    df = spark.createDataFrame([(0, 1, "a.rs", None, 0.8), (0, 2, "a.rs", None, 0.7), (0, 3, "a.rs", None, 0.6), (0, 4, "b.rs", None, 0.5)], "query_id int, id int, file_path string, name string, score double")
    got = {r.id: round(r.score, 6) for r in ranking.dampen(df).collect()}
    assert got == {1: 0.8, 2: 0.595, 3: 0.4335, 4: 0.5}
    one = df.where("file_path = 'a.rs'")
    assert {r.id: r.score for r in ranking.dampen(one).collect()} == {1: 0.8, 2: 0.7, 3: 0.6}
    t = df.withColumn("tokens", F.lit(10))
    assert [r.id for r in ranking.within_budget(t, 25, "tokens", "query_id", F.col("id")).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in ranking.within_budget(t, 5, "tokens", "query_id", F.col("id")).collect()] == [1]


def test_graph_rules(spark):
    e = spark.createDataFrame([(1, 2, "imports"), (2, 3, "imports"), (3, 1, "calls"), (4, 5, "contains")], "src long, dst long, rel_type string")
    seed = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in graph.reached(e, seed, 1).collect()} == {(2, 1)}
    assert {(r.node, r.depth) for r in graph.reached(e, seed, 3).collect()} == {(2, 1), (3, 2)}
    c = spark.createDataFrame([(1, 0.9), (2, 0.9), (4, 0.9)], "id long, importance double")
    imp = {r.id: round(r.importance, 4) for r in graph.importance(c, e, seed.select(F.lit(9).alias("id"))).collect()}
    assert imp[4] > 0.27 and imp[1] > 0.27 and imp[2] == round(0.9 * (0.3 + 0.3 * 0.30103), 4)
    rows = [(1, "f", "class", 0, 10), (2, "f", "method", 2, 4), (3, "f", "method", 12, 14), (4, "f", "enum", 20, 30), (5, "f", "constant", 21, 21)]
    ch = spark.createDataFrame(rows, "id long, file_path string, chunk_type string, line_start long, line_end long")
    assert {(r.src, r.dst) for r in graph.contains_edges(ch).collect()} == {(1, 2), (4, 5)}
    ents = spark.createDataFrame([(1, "class", "child"), (2, "class", "parent"), (3, "method", "run#3"), (4, "method", "run#4")], "id long, entity_type string, canonical_name string")
    deps = spark.createDataFrame([(1, 2, "Extends ", None), (1, 3, "contains", None), (2, 4, "contains", None)], "source_entity long, target_entity long, dep_type string, valid_to timestamp")
    assert [(r.src, r.dst) for r in graph.overrides(deps, ents).collect()] == [(3, 4)]


def test_entities_and_state(spark):
    rows = [("Foo Bar", "function", "a.py", 1, 2, None, 7), ("foo  bar", "class", "b.py", 3, 20, "sig", 8), (None, "x", None, None, None, None, None)]
    e = entities.upsert(spark.createDataFrame(rows, "name string, entity_type string, file_path string, line_start long, line_end long, signature string, chunk_id long")).collect()
    assert len(e) == 1 and (e[0].mentions, e[0].chunk_id, e[0].line_end, e[0].signature) == (2, 8, 20, "sig")
    text = spark.createDataFrame([("Caroline: I adopted a puppy named Max in May, about the garden",)], "t string")
    hints = text.select(entities.memory_hints(F.col("t")).alias("h")).first().h
    assert {"Caroline", "Max"} <= set(hints) and len(hints) <= 8
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {r.path: r.status for r in C.diff(a, b).collect()} == {"a": "unchanged", "b": "updated", "c": "removed", "d": "added"}


def test_manifests_and_ignores():
    import re

    assert files.aliases('{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/app/*"]}}}', "tsconfig") == {"@app/": "src/app"}
    assert files.aliases("module example.org/x\n", "go") == {"example.org/x/": ""}
    assert files.aliases('[workspace]\nmembers = ["crates/my-core"]\n', "cargo") == {"my_core": "crates/my-core/src/lib.rs"}
    p = re.compile(files.ignore_pattern(["*.log", "build/", "# no", "docs/old"]))
    assert p.search("a/x.log") and p.search("build/x") and p.search("docs/old/y") and not p.search("src/docs/older")
    assert files.ignore_pattern([]) is None

