import random

from chunkloom.llm import handwritten as H

COLUMNS = "id long, file_path string, content_raw string, source_type string, line_start long, path string, labelled string"


def body(rng):
    return "\n".join(f"def {rng.choice('load save read trim'.split())}_{rng.choice('queue graph shard'.split())}{chr(97 + k)}(value):\n    # {' '.join(rng.choice('keeps the rows until they are read again'.split()) for _ in range(6))}\n    return value + offset" for k in range(rng.randrange(3, 9)))


def getters(rng):
    return "\n".join(f"def get_f{k}(self):\n    return self._f{k}" for k in range(rng.randrange(8, 20)))


def test_notice():
    assert H.notice("# Code generated by tool 3.0. DO NOT EDIT.\nx = 1", True)
    assert H.notice("// SPDX\n// Copied verbatim from the foo distribution\nint a;", True)
    assert H.notice("/*! lib 3.1 */\nvar a=1", False)
    assert not H.notice("# replaces the vendored copy we had before\nx = 1", True)
    assert not H.notice('x = "This file is auto-generated"', True)
    assert not H.notice("# ids are generated by the caller\nx = 1", True)
    assert H.notice("static const unsigned char a[] = {\n" + "  0x13, 0x25, 0x80,\n" * 12 + "};", True)
    assert not H.notice("TABLE = [\n    56, // digest\n    51, // graph\n]", True)
    assert "DO NOT" not in H.without_header("# DO NOT EDIT\n\nx = 1")


def test_found_by_forest_and_notice(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        rows.append((k, f"src/a{k}.py", body(rng), "code", 0, "x", "y"))
    for k in range(60):
        head = "# @generated by x\n" if k < 30 else ""
        rows.append((1000 + k, f"src/g{k}.py", head + getters(rng), "code", 0, "x", "y"))
    rows.append((2000, "./src//g59.py ", getters(rng), "code", 30, "x", "y"))
    rows.append((2001, "docs/a.md", "# do not edit\ntext", "document", 0, "x", "y"))
    rows += [(3000, None, "x", "code", 0, "x", "y"), (3001, "src/null.py", None, "code", None, "x", "y"), rows[0], rows[401]]
    rows.append((3002, "src/long.py", body(rng) + "\n" + "x = 1\n" * 100_000, "code", 0, "x", "y"))
    df = spark.createDataFrame(rows, COLUMNS)
    found = {r.file_path for r in H.found(df).collect()}
    assert {f"src/g{k}.py" for k in range(60)} | {"./src//g59.py "} <= found
    assert len([p for p in found if p and p.startswith("src/a")]) <= 8  # precision on hand-written files
    assert "docs/a.md" not in found and None not in found
    assert H.found(df.limit(0)).count() == 0


def test_one_class_only(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, f"a{k}.py", body(rng), "code", 0, "x", "y") for k in range(5)], COLUMNS)
    assert H.found(df).count() == 0


def test_notice_in_a_long_header():
    licence = "\n".join(f"// line {k} of the licence" for k in range(20))
    assert H.notice(licence + "\n// Generated by foo 2.0 from a.x; do not edit.\nint a;", True)
    block = "/*\n" + "\n".join(f"  words {k}" for k in range(20)) + "\n  all changes will be lost\n*/\nint a;"
    assert H.notice(block, True) and H.without_header(block) == "int a;"
    assert not H.notice(licence + "\nint a; // do not edit", True)
