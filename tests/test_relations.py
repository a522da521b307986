import pytest

from chunkloom.engine import Engine
from chunkloom.functions import embed, stem
from chunkloom.operators import entities, graph, hierarchy, ranking, relations

CHUNKS = "id long, file_path string, chunk_type string, name string, content_raw string, line_start long, line_end long"


def chunks(spark, rows):
    return spark.createDataFrame([(*r, 0, 0)[:7] if len(r) == 5 else r for r in rows], CHUNKS)


@pytest.mark.parametrize(
    "text,want",
    [
        ("from a.b import x, y as z", {("a.b", ("x", "y"))}),
        ("from . import *\nimport os.path as p\r\n", {(".", ()), ("os.path", ())}),
        ("import { a, b as c, type D } from './m';\nimport * as n from \"k\";\nimport './side';", {("./m", ("a", "b", "D")), ("k", ()), ("./side", ())}),
        ("const q = require('../lib/q');", {("../lib/q", ())}),
        ("use crate::a::{b, c};\npub use super::d::E;", {("crate::a", ("b", "c")), ("super::d", ("E",))}),
        ("import (\n\t\"fmt\"\n\tm \"x/y\"\n)", {("fmt", ()), ("x/y", ())}),
        ("#include \"t.h\"\n#include <stdio.h>", {("t.h", ()), ("stdio.h", ())}),
        ("import static a.B;\nimport c.D;", {("a.B", ()), ("c.D", ())}),
        ("", set()),
    ],
)
def test_imports(spark, text, want):
    rows = chunks(spark, [(1, "p/a.x", "import", None, text), (2, "p/b.x", "import", None, None)])
    assert {(r.module, tuple(r.names)) for r in relations.imports(rows).collect()} == want


def test_import_edges(spark):
    rows = [
        (1, "p/src/a.py", "import", None, "from p.src.lib.util import one"),
        (2, "p/src/lib/util.py", "function", "one", "def one(): pass"),
        (3, "p/src/lib/util.py", "function", "two", "def two(): pass"),
        (4, "p/web/a.ts", "import", None, "import { go } from '../lib/m';\nimport './all';"),
        (5, "p/lib/m.ts", "function", "go", "x"),
        (6, "p/web/all/index.ts", "class", "K", "x"),
        (7, "p/web/all/index.ts", "constant", None, "x"),
        (8, "p/src/m/b.rs", "import", None, "use crate::other::thing;\nuse super::c::D;"),
        (9, "p/src/other.rs", "function", "thing", "x"),
        (10, "p/src/c.rs", "struct", "D", "x"),
        (11, "p/c/a.c", "import", None, "#include \"t.h\""),
        (12, "p/c/t.h", "function", "f", "x"),
        (13, "p/x.py", "import", None, "import missing.module"),
    ]
    got = {(r.src, r.dst, r.rel_type) for r in relations.import_edges(chunks(spark, rows)).collect()}
    assert got == {(1, 2, "imports"), (4, 5, "imports"), (4, 6, "imports"), (8, 9, "imports"), (8, 10, "imports"), (11, 12, "imports")}
    assert relations.import_edges(chunks(spark, [])).count() == 0


def test_structural_relations(spark):
    rows = [
        (1, "a.py", "class", "A", "class A(base.B, Mixin, metaclass=M):\n    pass"),
        (2, "a.ts", "class", "C", "export class C<T> extends D<T> implements E, F<G> {"),
        (3, "a.rs", "impl", None, "impl<T> fmt::Display for Thing<T> {"),
        (4, "a.ts", "interface", "I", "interface I extends J, K {"),
        (5, "a.rb", "class", "R", "class R < Base::S\nend"),
        (6, "a.py", "function", "f", "class A(B):"),
        (7, "a.py", "class", "O", "class O(object):"),
    ]
    found = relations.structural(chunks(spark, rows))
    got = {(r.heir, r.parent, r.rel_type) for r in found.collect()}
    assert got == {("A", "B", "extends"), ("A", "Mixin", "extends"), ("C", "D", "extends"), ("C", "E", "implements"), ("C", "F", "implements"), ("Thing", "Display", "implements"), ("I", "J", "extends"), ("I", "K", "extends"), ("R", "S", "extends")}
    ents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "id long, canonical_name string")
    assert {tuple(r) for r in relations.structural_deps(found, ents).collect()} == {(1, 2, "extends")}


def test_contains_and_overrides(spark):
    rows = [(1, "f", "class", "A", "", 0, 10), (2, "f", "method", "m", "", 2, 3), (3, "f", "method", "late", "", 12, 13), (4, "f", "class", "B", "", 20, 30), (5, "f", "constant", "c", "", 21, 30), (6, "g", "method", "m", "", 1, 2)]
    assert {tuple(r) for r in graph.contains_edges(chunks(spark, rows)).collect()} == {(1, 2), (4, 5)}
    ents = spark.createDataFrame([(1, "a", "class"), (2, "b", "class"), (3, "run#1", "method"), (4, "run#2", "method"), (5, "other", "method")], "id long, canonical_name string, entity_type string")
    deps = spark.createDataFrame([(1, 2, " Extends", None), (1, 3, "contains", None), (2, 4, "contains", None), (2, 5, "contains", None)], "source_entity long, target_entity long, dep_type string, valid_to timestamp")
    assert {tuple(r) for r in graph.overrides(deps, ents).collect()} == {(3, 4)}


def test_transitive_files(spark):
    rows = chunks(spark, [(i, f"f{i}", "function", "x", "") for i in range(5)] + [(9, "f0", "function", "y", "")])
    edges = spark.createDataFrame([(0, 1), (9, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "src long, dst long")
    got = {(r.target, r.depth) for r in relations.transitive_files(edges, rows, 3).where("source = 'f0'").collect()}
    assert got == {("f1", 1), ("f2", 2), ("f3", 3)}


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("electrical", "electr"), ("adoption", "adopt"), ("adjustment", "adjust"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("at", "at"), ("x9", "x9"), ("generalizations", "gener")])
def test_stems(word, want):
    assert stem.stem(word) == want


def test_vectors(spark):
    df = spark.createDataFrame([(1, "the queue"), (2, None), (3, ""), (4, "the queues")], "id long, text string")
    got = {r.id: r.embedding for r in embed.embedded(df, "text", embed.HashedGrams(32)).collect()}
    assert got[2] is None and got[3] == [0.0] * 32 and len(got[1]) == 32
    assert sum(a * b for a, b in zip(got[1], got[4])) > 0.7
    back = df.sparkSession.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>").select(embed.unpacked(embed.packed("v")).alias("v"))
    assert [r.v for r in back.collect()] == [[1.5, -2.0], [], None]


def test_nearest_in_rounds(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, v array<float>")
    whole = {tuple(r) for r in ranking.nearest(rows, rows, 3).collect()}
    monkeypatch.setattr(ranking, "QUERY_BYTES", 400)
    assert {tuple(r) for r in ranking.nearest(rows, rows, 3).collect()} == whole and len(whole) == 180


def test_gravity_layers_quality_groups(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, ["a"]), (1, 2, 3.0, ["a", "b"])], "query_id long, id long, score double, layers array<string>")
    assert sorted(r.score for r in ranking.gravity(rows, 0.5).collect()) == [1.5, 2.5]
    assert {tuple(r) for r in ranking.layers_hit(rows).collect()} == {("a", 2), ("b", 1)}


def test_attributes_and_hints_are_added_once(spark):
    schema = "id long, entity_id long, kind string, content string"
    old = spark.createDataFrame([(1, 1, "k", "c")], schema)
    new = spark.createDataFrame([(2, 1, "k", "c"), (3, 1, "k", "d"), (4, 1, "k", "d"), (5, None, "k", "e")], schema)
    assert {r.id for r in entities.add_attributes(old, new).collect()} == {1, 3}
    h = "chunk_id long, hint_text string, hint_type string"
    out = entities.add_hints(spark.createDataFrame([(1, "a", "symbol")], h), spark.createDataFrame([(1, "a", None), (1, "b", None), (1, "b", None)], h))
    assert {tuple(r) for r in out.collect()} == {(1, "a", "symbol"), (1, "b", "plain")}


def test_other_parents_and_descendants(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 3), (2, 3), (1, 3), (3, 4), (5, 6), (6, 5)], "parent long, child long")
    assert {tuple(r) for r in hierarchy.other_parents(edges).collect()} == {(3, 2, 1, 2)}
    monkeypatch.setattr(hierarchy, "RANGE", 2)
    tree = hierarchy.nested_sets(edges)
    got = {tuple(r) for r in hierarchy.descendants(tree, tree.selectExpr("node as ancestor")).collect()}
    assert got == {(1, 3), (1, 4), (3, 4)}


def test_engine_builds_edges_hints_and_vectors(spark, tmp_path):
    root = tmp_path / "s"
    (root / "p").mkdir(parents=True)
    (root / "p" / "base.py").write_text("class Base:\n    def run(self):\n        return 1\n\ndef helper():\n    return 2\n")
    (root / "p" / "main.py").write_text("from p.base import Base, helper\n\nclass Main(Base):\n    def go(self):\n        return helper()\n")
    e = Engine(spark, str(tmp_path / "i"), provider=embed.HashedGrams(32))
    e.index(str(root))
    names = {r.id: r.name for r in e.chunks().collect()}
    edges = {(r.rel_type, names[r.dst]) for r in e.store.read("edges").collect()}
    assert ("imports", "helper") in edges and ("calls", "helper") in edges
    ids = {r.id: r.canonical_name for r in e.store.read("entities").collect()}
    assert ("main", "base", "extends") in {(ids[r.source_entity], ids[r.target_entity], r.dep_type) for r in e.store.read("dependencies").collect()}
    assert e.store.read("vectors").count() == len(names) and e.embed() == 0
    assert e.call("entities", entity_type="class")["ok"] and e.call("file_deps", path="p/main.py")["result"][0]["target"] == "p/base.py"
    assert e.call("entity_deps", name="Main")["result"] and e.call("communities")["ok"] and e.call("tree")["ok"]
    assert e.call("vector_search", query="def helper", top_k=2)["ok"]
    some = next(i for i, n in names.items() if n == "helper")
    assert "helper" in e.call("render", ids=[some])["result"] and e.call("hints", chunk_id=some)["result"]
