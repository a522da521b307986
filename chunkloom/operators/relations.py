"""From source text to edges: imports and what they resolve to, inheritance, and files that depend on each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.operators import graph

#: Chunk types that an import can name; endings tried for a path without one, and files that stand for a folder.
DECLARED = ("function", "class", "interface", "struct", "enum", "trait", "constant", "type", "method", "impl")
ENDINGS = ("ts", "tsx", "js", "jsx", "py", "rs", "go", "rb", "lua", "java", "c", "h")
FOLDER_FILES = ("index.ts", "index.js", "__init__.py", "mod.rs")

#: Statement forms: the group of the module, the group of the imported names (0: none are named).
_FORMS = (
    (r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+\(?([^\n)#]+)", 1, 2),
    (r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)(?:[ \t]+as[ \t]+\w+)?[ \t]*;?[ \t]*\r?$", 1, 0),
    (r"(?m)^[ \t]*(?:import|export)\b[^\n'\"{]*\{([^}]*)\}[^\n'\"]*from[ \t]*['\"]([^'\"\n]+)['\"]", 2, 1),
    (r"(?m)^[ \t]*import\b[^\n'\"{}]*['\"]([^'\"\n]+)['\"]", 1, 0),
    (r"\brequire(?:_relative)?[ \t]*\(?[ \t]*['\"]([^'\"\n]+)['\"]", 1, 0),
    (r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)::\{([^}]*)\}", 1, 2),
    (r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)::(\w+)(?:[ \t]+as[ \t]+\w+)?[ \t]*;", 1, 2),
    (r"(?m)^[ \t]*#[ \t]*include[ \t]+[<\"]([^>\"\n]+)[>\"]", 1, 0),
    (r"(?m)^[ \t]*(?:\w+[ \t]+)?\"([\w./-]+)\"[ \t]*\r?$", 1, 0),
    (r"(?m)^[ \t]*(?:source|\.)[ \t]+[\"']?([\w./-]+)", 1, 0),
)


def imports(chunks: DataFrame) -> DataFrame:
    """id, file_path, module, names of each import statement; names is empty where the whole module is meant.

    `names` are those of the module, not what they are renamed to.  A statement
    that stands twice in a chunk counts once.  Null texts have none.
    """
    text = F.col("content_raw")

    def names(said: Column) -> Column:
        parts = F.transform(F.split(said, ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+as\s+\w+", ""), r"^\s*type\s+", "")))
        return F.filter(parts, lambda x: x.rlike(r"^\w+$"))

    def form(pattern: str, module: int, named: int) -> Column:
        modules = F.regexp_extract_all(text, F.lit(pattern), module)
        if not named:
            return F.transform(modules, lambda m: F.struct(m.alias("module"), F.array().cast("array<string>").alias("names")))
        return F.zip_with(modules, F.regexp_extract_all(text, F.lit(pattern), named), lambda m, n: F.struct(m.alias("module"), names(n).alias("names")))

    each = F.array_distinct(F.concat(*[form(*f) for f in _FORMS]))
    return chunks.where(text.isNotNull()).select("id", "file_path", F.explode(each).alias("x")).select("id", "file_path", "x.module", "x.names")


def _joined(folder: Column, rest: Column) -> Column:
    """A relative path against a folder, `.` and `..` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", folder, rest), "/"), lambda p: ~p.isin("", "."))
    out = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when(p != "..", F.concat(held, F.array(p))).otherwise(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))))
    return F.array_join(out, "/")


def candidates(module: Column, source: Column) -> Column:
    """Paths that a module of a source file may stand for, the likelier first.

    Relative paths and bare file names go against the source's folder; `crate::`
    against the folder `src` above it or the project, `super::` and `self::`
    against its folder; dotted names against the project's root (the first
    folder), the source's folder and the root of all.
    """
    folder = F.regexp_replace(source, "(^|/)[^/]*$", "")
    project = F.split(source, "/")[0]
    slashed = F.regexp_replace(F.regexp_replace(module, r"^(?:crate|super|self)::", ""), r"::|\.(?=\w+(?:\.|$))", "/")
    crate = F.when(source.rlike("(^|/)src/"), F.regexp_replace(source, "((?:^|.*/)src)/.*$", "$1")).otherwise(project)
    base = (
        F.when(module.rlike(r"^\.{1,2}/") | module.rlike(rf"^[\w-]+(?:/[\w-]+)*\.(?:{'|'.join(ENDINGS)}|hpp|hh|sh|json|css)$"), F.array(_joined(folder, module)))
        .when(module.startswith("crate::"), F.array(_joined(crate, slashed)))
        .when(module.startswith("super::"), F.array(_joined(F.regexp_replace(folder, "(^|/)[^/]*$", ""), slashed), _joined(folder, slashed)))
        .when(module.startswith("self::"), F.array(_joined(folder, slashed)))
        .when(module.rlike(r"^\.+\w"), F.array(_joined(folder, F.concat(F.repeat(F.lit("../"), F.length(F.regexp_extract(module, r"^(\.+)", 1)) - 1), F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")))))
        .otherwise(F.array(_joined(project, slashed), _joined(folder, slashed), slashed))
    )
    tried = F.transform(base, lambda b: F.concat(F.array(b), *[F.array(F.concat(b, F.lit(f".{e}"))) for e in ENDINGS], *[F.array(F.concat(b, F.lit(f"/{f}"))) for f in FOLDER_FILES]))
    return F.array_distinct(F.flatten(tried))


def resolved(found: DataFrame, files: DataFrame) -> DataFrame:
    """The imports (file_path, module, names) with `target`: each candidate path that `files` (path) holds."""
    each = found.withColumn("target", F.explode(candidates(F.col("module"), F.col("file_path"))))
    return each.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi").where("target <> file_path")


def import_edges(chunks: DataFrame) -> DataFrame:
    """src, dst, rel_type `imports`: from a file's first import chunk to the declarations that it imports.

    All declarations of the target file where no names are given.
    """
    found = resolved(imports(chunks.where(F.col("chunk_type").isin("import", "module", "section"))), chunks.select(F.col("file_path").alias("path")))
    first = chunks.where(F.col("chunk_type") == "import").groupBy("file_path").agg(F.min("id").alias("src"))
    declared = chunks.where(F.col("chunk_type").isin(*DECLARED) & F.col("name").isNotNull()).select(F.col("file_path").alias("target"), F.col("id").alias("dst"), "name")
    wanted = F.size("names") == 0
    both = found.join(declared, "target").where(wanted | F.array_contains("names", F.col("name")))
    return both.join(first, "file_path").where("src <> dst").select("src", "dst", F.lit("imports").alias("rel_type")).distinct()


#: Forms of inheritance: pattern over a declaration, the group of the heirs' name, that of its parents, and the type of edge.
_HEIRS = (
    (r"(?m)^[ \t]*class[ \t]+(\w+)[ \t]*\(([^()\n]*)\)[ \t]*:", 1, 2, "extends"),
    (r"\bclass[ \t]+(\w+)(?:<[^>\n]*>)?[^{\n]*?\bextends[ \t]+([\w.$]+)", 1, 2, "extends"),
    (r"\bclass[ \t]+(\w+)(?:<[^>\n]*>)?[^{\n]*?\bimplements[ \t]+([\w.$, \t<>]+)", 1, 2, "implements"),
    (r"\binterface[ \t]+(\w+)(?:<[^>\n]*>)?[ \t]+extends[ \t]+([\w.$, \t<>]+)", 1, 2, "extends"),
    (r"(?m)^[ \t]*(?:unsafe[ \t]+)?impl(?:<[^>\n]*>)?[ \t]+([\w:]+)(?:<[^>\n]*>)?[ \t]+for[ \t]+(\w+)", 2, 1, "implements"),
    (r"(?m)^[ \t]*class[ \t]+(\w+)[ \t]*<[ \t]*([\w:]+)", 1, 2, "extends"),
)


def structural(chunks: DataFrame) -> DataFrame:
    """id, heir, parent, rel_type of each inheritance that a declaration states; arguments and packages of parents are left out."""
    text = F.col("content_raw")

    def form(pattern: str, heir: int, parents: int, kind: str) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), heir).alias("heir"), F.regexp_extract_all(text, F.lit(pattern), parents).alias("parents"))
        split = F.transform(pairs, lambda p: F.transform(F.filter(F.split(F.regexp_replace(p["parents"], "<[^>]*>", ""), ","), lambda x: ~F.contains(x, F.lit("="))), lambda x: F.struct(p["heir"].alias("heir"), F.regexp_extract(x, r"(\w+)[ \t]*$", 1).alias("parent"), F.lit(kind).alias("rel_type"))))
        return F.filter(F.flatten(split), lambda x: ~x["parent"].isin("", "object", "Object"))

    some = chunks.where(text.isNotNull() & F.col("chunk_type").isin("class", "struct", "interface", "trait", "impl", "enum", "section"))
    each = F.array_distinct(F.concat(*[form(*h) for h in _HEIRS]))
    return some.select("id", F.explode(each).alias("x")).select("id", "x.*")


def structural_deps(found: DataFrame, entities: DataFrame) -> DataFrame:
    """source_entity, target_entity, dep_type of inheritances whose both ends are entities by canonical name; others are dropped."""
    e = entities.select("id", "canonical_name").distinct()
    a = e.select(F.col("id").alias("source_entity"), F.col("canonical_name").alias("heir"))
    b = e.select(F.col("id").alias("target_entity"), F.col("canonical_name").alias("parent"))
    low = found.select(F.lower("heir").alias("heir"), F.lower("parent").alias("parent"), F.col("rel_type").alias("dep_type")).distinct()
    return low.join(a, "heir").join(b, "parent").where("source_entity <> target_entity").select("source_entity", "target_entity", "dep_type").distinct()


def transitive_files(edges: DataFrame, chunks: DataFrame, hops: int) -> DataFrame:
    """source, target, depth of the files that each file depends on within some hops, over chunk edges (src, dst).

    The closure runs over distinct files, not over their chunks.
    """
    place = chunks.select("id", "file_path")
    pairs = edges.join(place.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(place.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst")
    steps = pairs.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    seeds = steps.select(F.col("src").alias("node")).distinct()
    return graph.reached(steps, seeds, hops).select(F.col("origin").alias("source"), F.col("node").alias("target"), "depth")
