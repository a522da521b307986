"""Cutting texts into sections and finding calls, by window functions and regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Beginnings of lines that open a section; lines of a section at most.
PREFIXES = (
    "fn ", "pub fn ", "async fn ", "def ", "class ", "function ", "func ", "pub struct ", "struct ", "pub enum ", "enum ", "impl ", "trait ", "interface ", "type ",
    "module ", "export ", "const ", "let ", "var ", "import ", "from ", "use ", "#include", "package ", "namespace ", "public ", "private ", "protected ",
)
SECTION_LINES = 50
#: Words before a bracket that are no calls.
KEYWORDS = (
    "if else for while match return await async let const var fn function new delete throw try catch finally import export from class extends super this self Self "
    "print println println! format! vec! dbg! eprintln! assert assert_eq assert_ne assert! panic! unimplemented! todo! unreachable! vec Vec String HashMap Option Result Some None Ok Err Box Rc Arc "
    "true false mut pub use mod struct enum impl trait type where in as ref static dyn box move loop break continue yield def pass with "
    "isinstance len range str int float bool list dict set tuple make append Error Promise console log typeof instanceof"
).split()


def _sections(rows: DataFrame, key: str, text: str, opens: Column, most: int | None) -> DataFrame:
    """key, section, line_start, line_end (exclusive), content; a section opens where `opens` is true of `line`, or is full."""
    each = rows.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("n", "line")).withColumn("open", opens.cast("int"))
    w = Window.partitionBy(key).orderBy("n")
    part = each.withColumn("part", F.sum("open").over(w))
    by = ["part"]
    if most:
        inner = Window.partitionBy(key, "part").orderBy("n")
        part = part.withColumn("piece", F.floor((F.row_number().over(inner) - 1) / most))
        by.append("piece")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return part.groupBy(key, *by).agg(F.min("n").alias("line_start"), (F.max("n") + 1).alias("line_end"), body.alias("content"))


def line_sections(rows: DataFrame, key: str = "id", text: str = "content_raw") -> DataFrame:
    """Sections that open at declarations or after SECTION_LINES lines; name: the first line under 80 characters."""
    opens = F.lit(False)
    for p in PREFIXES:
        opens = opens | F.ltrim(F.col("line")).startswith(p)
    out = _sections(rows, key, text, opens & (F.col("n") > 0), SECTION_LINES)
    first = F.trim(F.split("content", "\n")[0])
    return out.select(key, "line_start", "line_end", F.when(F.length(first) < 80, first).alias("name"), "content")


def markdown_sections(rows: DataFrame, key: str = "id", text: str = "content_raw") -> DataFrame:
    """Sections under each Markdown heading, headings in fenced blocks aside; level and title of the heading."""
    each = rows.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    inside = F.sum(fence.cast("int")).over(w) % 2 == 1
    each = each.withColumn("head", F.col("line").rlike(r"^#{1,6} ") & ~inside & ~fence).withColumn("part", F.sum(F.col("head").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    out = each.groupBy(key, "part").agg(F.min("n").alias("line_start"), (F.max("n") + 1).alias("line_end"), body.alias("content"))
    first = F.split("content", "\n")[0]
    level = F.when(F.col("part") > 0, F.length(F.regexp_extract(first, "^(#+)", 1))).otherwise(0)
    return out.select(key, "line_start", "line_end", level.alias("level"), F.when(F.col("part") > 0, F.trim(F.regexp_replace(first, "^#+", ""))).alias("title"), "content")


def calls(text: Column) -> Column:
    """Distinct names before an opening bracket, keywords aside, in the order of first use."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^.\w])(\w+)\s*\("), 1)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(k) for k in KEYWORDS]))


def call_edges(chunks: DataFrame) -> DataFrame:
    """src, dst: each chunk that calls a name that a chunk of the same project (first folder) declares, itself aside."""
    project = F.split("file_path", "/")[0]
    called = chunks.where(F.col("chunk_type").isin("function", "method", "section")).select(F.col("id").alias("src"), project.alias("project"), F.explode(calls(F.col("content_raw"))).alias("name"))
    declared = chunks.where(F.col("chunk_type").isin("function", "method", "class", "struct") & F.col("name").isNotNull()).select(F.col("id").alias("dst"), project.alias("project"), "name")
    return called.join(declared, ["project", "name"]).where("src <> dst").select("src", "dst").distinct()


def imports(text: Column) -> Column:
    """Distinct module paths that a text imports, by the statements of the common languages."""
    patterns = (
        r"(?m)^\s*from\s+([\w.]+)\s+import\b",
        r"(?m)^import\s+([\w.]+)\s*;?\s*$",
        r"(?m)^\s*import\b[^\n'\"]*['\"]([^'\"\n]+)['\"]",
        r"\brequire(?:_relative)?\s*\(?\s*['\"]([^'\"\n]+)['\"]",
        r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)",
        r"(?m)^\s*#include\s+[<\"]([^>\"\n]+)[>\"]",
        r"(?m)^\t\"([\w./-]+)\"\s*$",
    )
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in patterns])))


def import_targets(module: Column, source: Column) -> Column:
    """Candidate files of a relative module path, against the file that imports it."""
    folder = F.regexp_replace(source, "/[^/]*$", "")
    base = F.concat(folder, F.lit("/"), F.regexp_replace(module, r"^\./", ""))
    endings = ("ts", "tsx", "js", "jsx", "py", "rs", "go", "rb", "lua", "java", "c", "h")
    return F.when(module.startswith("./") | module.rlike(r"^\w+(\.h)?$"), F.array(*[F.concat(base, F.lit("." + e)) for e in endings], base, F.concat(base, F.lit("/index.ts")), F.concat(base, F.lit("/__init__.py")), F.concat(base, F.lit("/mod.rs")))).otherwise(F.array())
