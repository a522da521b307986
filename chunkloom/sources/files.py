"""Project files as tables: scan, ignore rules, hashes and manifests."""

from __future__ import annotations

import fnmatch
import json
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import scalar

#: Folders that a walk never enters.
SKIPPED = ("node_modules", "target", "dist", "build", "vendor", "__pycache__", "venv", "coverage", "out", "bin", "obj", "tmp")


def ignore_pattern(rules: list[str]) -> str | None:
    """One regular expression of glob rules as ignore files have them; null without rules.

    A rule ending in `/` means a folder, one with an inner `/` is anchored at the
    root, `!` rules and comments are skipped.
    """
    parts = []
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith(("#", "!")):
            continue
        anchored = "/" in rule.rstrip("/")
        body = fnmatch.translate(rule.strip("/")).replace(r"\Z", "").replace("(?s:", "(?:").replace(".*", "[^/]*").replace(r"\z", "")
        parts.append(("^" if anchored else "(?:^|/)") + body + ("/" if rule.endswith("/") else "(?:/|$)"))
    return "|".join(parts) or None


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path, language, size, mtime, hash, content of the text files under a root.

    Hidden files, SKIPPED folders, ignored paths, unknown languages and files
    that are no UTF-8 are left out.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/"))
    path = F.regexp_replace("path", f"^(?:file:/*)?/?{base.lstrip('/')}/+", "")
    out = rows.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("content").alias("_raw"))
    out = out.withColumn("language", scalar.language(F.col("path"))).where(F.col("language").isNotNull() & ~F.col("path").rlike(rf"(?:^|/)(?:\.[^/]+|{'|'.join(SKIPPED)})/"))
    out = out.where(~F.col("path").rlike(r"(?:^|/)\.(?!env)[^/]*$"))
    pattern = ignore_pattern(ignore or [])
    if pattern:
        out = out.where(~F.col("path").rlike(pattern))
    return out.where(F.is_valid_utf8(F.col("_raw").cast("string"))).select("path", "language", "size", "mtime", F.sha2("_raw", 256).alias("hash"), F.decode("_raw", "UTF-8").alias("content"))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose time and hash differ from the known ones (path, mtime, hash)."""
    old = known.select("path", F.col("mtime").alias("_m"), F.col("hash").alias("_h"))
    same = F.coalesce((F.abs(F.col("mtime") - F.col("_m")) < 0.001) | (F.col("hash") == F.col("_h")), F.lit(False))
    return found.join(old, "path", "left").where(~same).drop("_m", "_h")


def aliases(text: str, kind: str) -> dict[str, str]:
    """Prefixes of module paths by manifest: `tsconfig`, `cargo`, `go` or `pyproject`."""
    if kind == "tsconfig":
        options = json.loads(re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)).get("compilerOptions", {})
        base = options.get("baseUrl", ".").strip("./")
        return {k.rstrip("*"): "/".join(x for x in (base, v[0].rstrip("*").strip("./")) if x) for k, v in options.get("paths", {}).items() if v}
    if kind == "cargo":
        return {m.split("/")[-1].replace("-", "_"): f"{m}/src/lib.rs" for m in tomllib.loads(text).get("workspace", {}).get("members", [])}
    if kind == "go":
        m = re.search(r"(?m)^module\s+(\S+)", text)
        return {m[1] + "/": ""} if m else {}
    project = tomllib.loads(text).get("project", {}).get("name", "")
    return {project.replace("-", "_"): project.replace("-", "_")} if project else {}


def resolve(module: Column, table: dict[str, str]) -> Column:
    """A module path with its longest known prefix replaced; null where none fits."""
    out = F.lit(None).cast("string")
    for prefix in sorted(table, key=len):
        out = F.when(module.startswith(prefix), F.concat(F.lit(table[prefix]), F.substring(module, F.lit(len(prefix) + 1), F.length(module)))).otherwise(out)
    return out


def knowledge(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Knowledge rows (content, chunk_type, source_type, name, importance, tags, ...) as a table."""
    kinds = "content_raw string, chunk_type string, source_type string, name string, importance double, agent_id string, tags array<string>, decay_rate double, created_by string"
    fields = [x.split()[0] for x in kinds.split(", ")]
    data = [tuple(r.get("content" if f == "content_raw" else f) for f in fields) for r in rows]
    out = spark.createDataFrame(data, kinds)
    return out.withColumn("importance", F.coalesce("importance", scalar.prior(F.col("chunk_type")), F.lit(0.5)))
