import pytest

from chunkloom.llm import docpairs as P


def good(text, language):
    return [name for name, _, _, _, dull in P.functions(text, language) if not dull]


SENTENCE = "Counts the rows that are left open after the last run."


@pytest.mark.parametrize(
    "language,text,names",
    [
        ("python", f'def f(\n    a: int = (1),\n) -> dict:\n    """{SENTENCE}"""\n    return a\n', ["f"]),
        ("python", f"# {SENTENCE}\n@cache(\n    size=2,\n)\nasync def g(x):\n    pass\n", ["g"]),
        ("python", f"def f():\n    x = '''{SENTENCE}'''\n", []),
        ("go", f"// Do {SENTENCE}\nfunc (r *T) Do(a int) error {{\n}}\n", ["Do"]),
        ("rust", f"/// {SENTENCE}\n#[must_use]\npub(crate) async fn load(&self) -> X {{\n}}\n", ["load"]),
        ("java", f"/**\n * {SENTENCE}\n * @param a x\n */\n@Override\npublic static List<Item> run(List<Item> a) {{\n}}\n", ["run"]),
        ("java", f"public void run() {{\n    /** {SENTENCE} */\n}}\n", []),
        ("typescript", f"// {SENTENCE}\nexport const run = async (a: Item[]) => {{\n}};\n", ["run"]),
        ("typescript", f"/** {SENTENCE} */\nstatic doIt(a: string): void {{\n}}\n", ["doIt"]),
        ("c", f"/* {SENTENCE} */\nstatic size_t *count_all(int *a) {{\n    return 0;\n}}\n", ["count_all"]),
        ("ruby", f"# {SENTENCE}\ndef self.go!(a)\nend\n", ["go!"]),
        ("lua", f"--- {SENTENCE}\nlocal function go(a)\nend\n", ["go"]),
        ("shell", f"# {SENTENCE}\nfunction go {{\n}}\n\n# {SENTENCE}\nstop() {{\n}}\n", ["go", "stop"]),
        ("ruby", f"# {SENTENCE}\n\ndef far(a)\nend\n", []),
        ("csharp", f"/// <summary>\n/// {SENTENCE}\n/// </summary>\n[Obsolete]\npublic async Task<int> RunAsync(int a)\n{{\n}}\n", ["RunAsync"]),
        ("csharp", f"/// {SENTENCE}\npublic int Twice(int a) => a * 2;\n", ["Twice"]),
        ("kotlin", f"/** {SENTENCE} */\noverride fun load(a: Int): Int = a\n", ["load"]),
        ("swift", f"/// {SENTENCE}\n@discardableResult\npublic func load(a: Int) -> Int {{\n}}\n", ["load"]),
        ("php", f"/** {SENTENCE} */\npublic static function load($a) {{\n}}\n", ["load"]),
        ("scala", f"/** {SENTENCE} */\ndef load(a: Int): Int = a\n", ["load"]),
        ("dart", f"/// {SENTENCE}\nFuture<int> load(int a) async {{\n}}\n", ["load"]),
        ("python", f"# {SENTENCE}\n@many(\n" + "    1,\n" * 50 + ")\ndef g(x):\n    pass\n", ["g"]),
        ("javascript", "if (a) {\n}\nfor (const x of y) {\n}\n", []),
    ],
)
def test_attached(language, text, names):
    assert good(text, language) == names
    assert good(text.replace("\n", "\r\n"), language) == names


@pytest.mark.parametrize(
    "doc",
    ["TODO", "FIXME write docs for this before the next release", "noqa: C901", "eslint-disable-next-line no-unused-vars", "This function will load big data.", "The load big data function.", "loadBigData()", "return old_load(value, 3);", "See above.", "No description provided.", "-----------", "...", "@param data\n@return", ":param data:\n:return:", "@inheritDoc", "nolint:gocyclo", "n/a", ""],
)
def test_trivial(doc):
    assert P.trivial(P.cleaned(["// " + x for x in doc.split("\n")]), "loadBigData")


@pytest.mark.parametrize("doc", [SENTENCE, "TODO: drop this later. " + SENTENCE, "@returns " + SENTENCE, "Renvoie les lignes que la file n'a pas encore lues.", "断片を読み込み、古い項目を取り除いてから返す。", "Prüft, ob der Index noch gebraucht wird."])
def test_not_trivial(doc):
    assert not P.trivial(P.cleaned(["# " + doc]), "loadBigData")


def test_bodies_and_table(spark):
    ruby = f"# {SENTENCE}\ndef a(x)\n  if x\n    1\n  end\nend\n\n# {SENTENCE}\ndef b\nend\n"
    rows = [(1, "ruby", "a.rb", "section", ruby, "c"), (1, "ruby", "a.rb", "section", ruby, "c"), (2, None, "b.py", "function", f'def q():\n    """{SENTENCE}"""\n    return 1\n', "c"), (3, "python", "c.py", "function", None, "c"), (4, "python", "c.py", "function", "", "c"), (5, "python", "c.py", "class", f'def z():\n    """{SENTENCE}"""\n', "c"), (6, "klingon", "x", "function", "def a", "c")]
    df = spark.createDataFrame(rows, "id long, language string, file_path string, chunk_type string, content_raw string, func_name string")
    got = {(r.chunk_id, r.func_name): r.code for r in P.pairs(df).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "q")}
    assert got[(1, "a")].endswith("  end\nend") and got[(1, "b")] == "def b\nend"
    assert {(r.language, r.chunks) for r in P.skipped(df).collect()} == {("klingon", 1)}
    assert P.pairs(df.limit(0)).count() == 0


def test_functions_of_one_name_stay_apart(spark):
    text = f"# {SENTENCE}\ndef run(a)\n  1\nend\n\n# Other words that say what this one does.\ndef run(b)\n  b\nend\n"
    df = spark.createDataFrame([(1, "ruby", "a.rb", "section", text)], "id long, language string, file_path string, chunk_type string, content_raw string")
    assert sorted((r.line_no, r.code) for r in P.pairs(df).collect()) == [(2, "def run(a)\n  1\nend"), (7, "def run(b)\n  b\nend")]


def test_bodies_without_braces():
    text = f"/** {SENTENCE} */\nfun a(x: Int): Int = x + 1\n\n/** {SENTENCE} */\nfun b(x: Int): Int {{\n  return x\n}}\n"
    assert [code for _, _, _, code, _ in P.functions(text, "kotlin")] == ["fun a(x: Int): Int = x + 1", "fun b(x: Int): Int {\n  return x\n}"]
