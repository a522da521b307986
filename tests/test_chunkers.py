import pytest

from chunkloom.operators import sections as S
from chunkloom.sources import chunkers as K

PYTHON = "import os\nfrom .models import A\n\nMAX_RETRIES = 3\nvalue = 2\n\nclass UserRepository:\n    def a(self):\n        pass\n\n    @x\n    def b(self):\n        return 1\n\n@d\ndef f(x):\n    return x\n"


def kinds(text, language):
    return [(c.kind, c.name) for c in K.chunk_text(text, language)]


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("python", PYTHON, [("import", None), ("import", None), ("constant", "MAX_RETRIES"), ("class", "UserRepository"), ("method", "a"), ("method", "b"), ("function", "f")]),
        ("rust", "pub struct P {\n    x: i32,\n}\nimpl P {\n    pub fn new() -> Self {\n        P { x: 1 }\n    }\n}\nfn main() {\n}\n", [("struct", "P"), ("impl", "P"), ("method", "new"), ("function", "main")]),
        ("typescript", "export class A extends B {\n    run(a: string): void {\n        if (a) { return; }\n    }\n}\nexport const f = async (x) => {\n};\n", [("class", "A"), ("method", "run"), ("function", "f")]),
        ("go", 'import (\n\t"fmt"\n)\nfunc (x *T) Do(a int) error {\n\treturn nil\n}\n', [("import", None), ("method", "Do")]),
        ("ruby", "class A\n  def b\n    if x\n      1\n    end\n  end\nend\n", [("class", "A"), ("method", "b")]),
        ("java", "public class A {\n    public int get(int a) {\n        return x;\n    }\n}\n", [("class", "A"), ("method", "get")]),
        ("c", "#include <a.h>\nstatic int f(int a) {\n    return a;\n}\n", [("import", "<a.h>"), ("function", "f")]),
        ("markdown", "# A\ntext\n```sh\n# no\n```\n## B\nmore", [("document_section", "A"), ("section", "A [sh]"), ("document_section", "B")]),
        ("toml", "x = 1\n[a]\nb = 2\n", [("constant", "x"), ("module", "a")]),
        ("yaml", "a:\n  b: 1\nc: 2\n", [("constant", "a"), ("constant", "b"), ("constant", "c")]),
    ],
)
def test_languages(language, text, want):
    got = kinds(text, language)
    assert [x for x in got if x in want or x[0] != "section"] == want


def test_every_line_is_covered_once_by_the_top_level():
    text = "\n".join(f"x{k} = {k}" for k in range(130))
    found = K.chunk_text(text, "python")
    lines = sorted(k for c in found for k in range(c.start, c.end + 1))
    assert lines == list(range(130)) and max(c.end - c.start + 1 for c in found) <= 50


def test_broken_and_empty():
    assert kinds("def broken(:\n  x", "python")[0][0] == "section"
    assert K.chunk_text("", "python") == [] and K.chunk_text(None, None) == []


def test_table_and_plugin(spark):
    rows = [("a.py", "python", PYTHON), ("b.zz", None, "one\ntwo"), ("c.py", "python", None)]
    df = spark.createDataFrame(rows, "path string, language string, content string")
    out = K.chunks(df).collect()
    assert {r.file_path for r in out} == {"a.py", "b.zz"} and len({r.id for r in out}) == len(out)
    own = K.chunks(df, extra={"python": lambda lines: [K.Chunk("module", "all", 0, len(lines) - 1)]}).where("file_path = 'a.py'").collect()
    assert [(r.chunk_type, r.name) for r in own] == [("module", "all")]


def test_calls_and_imports(spark):
    df = spark.createDataFrame([("def f(x):\n  return g(x) + obj.h(1) + if (y) k (2)\n", "import a.b\nfrom c.d import e\nconst q = require('./x');\nuse crate::m::n;\n")], "t string, i string")
    r = df.select(S.calls(df.t).alias("c"), S.imports(df.i).alias("m")).first()
    assert r.c == ["f", "g", "k"] and set(r.m) == {"a.b", "c.d", "./x", "crate::m::n"}
