"""Source files to chunks: one table function with a chunker per language.

Python goes through its own parser; Markdown, HTML, JSON, YAML, TOML and CSS
through small scanners; the languages with brackets or end keywords through
declaration patterns and a scan for the end of the body that skips strings and
comments.  Whatever no chunk claims becomes sections of at most 50 lines, so
every line of a file is covered once.  Other languages are cut by lines.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.scalar import PRIORS
from chunkloom.operators.sections import PREFIXES, SECTION_LINES


@dataclass
class Chunk:
    """Lines [start, end] (0-based, inclusive) of a file."""

    kind: str
    name: str | None
    start: int
    end: int
    importance: float | None = None
    source_type: str = "code"
    flags: dict[str, str] = field(default_factory=dict)


Chunker = Callable[[list[str]], list[Chunk]]

SCHEMA = "file_path string, language string, chunk_type string, name string, signature string, line_start long, line_end long, content_raw string, content_hash string, importance double, source_type string, metadata map<string,string>"


# --- Python --------------------------------------------------------------------
def python(lines: list[str]) -> list[Chunk]:
    """Imports, functions, classes with their methods, and upper-case constants of the top level."""
    tree = ast.parse("\n".join(lines))
    out = []
    for node in tree.body:
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]]) - 1
        last = (node.end_lineno or node.lineno) - 1
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out.append(Chunk("import", None, first, last))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(Chunk("function", node.name, first, last))
        elif isinstance(node, ast.ClassDef):
            out.append(Chunk("class", node.name, first, last))
            for sub in node.body:
                if isinstance(sub, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    top = min([sub.lineno, *[d.lineno for d in sub.decorator_list]]) - 1
                    out.append(Chunk("method", sub.name, top, (sub.end_lineno or sub.lineno) - 1))
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9]*_[A-Z0-9_]+", node.targets[0].id):
            out.append(Chunk("constant", node.targets[0].id, first, last))
    return out


# --- languages with declarations -------------------------------------------------
_ID = r"([A-Za-z_$][\w$]*)"
#: By language: how a body ends, and (kind, pattern) of declarations; a kind is that of its first match.
_RULES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "rust": ("brace", [("import", r"use\s+([\w:]+)"), ("function", rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+{_ID}"), ("struct", rf"(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}"), ("enum", rf"(?:pub(?:\([^)]*\))?\s+)?enum\s+{_ID}"), ("trait", rf"(?:pub\s+)?trait\s+{_ID}"), ("impl", r"impl(?:<[^>]*>)?\s+([\w:<>, ]+?)\s*\{"), ("module", rf"(?:pub\s+)?mod\s+{_ID}"), ("constant", rf"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+{_ID}"), ("type", rf"(?:pub\s+)?type\s+{_ID}"), ("macro", rf"macro_rules!\s*{_ID}")]),
    "typescript": ("brace", [("import", r"import\b()"), ("function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"), ("class", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}"), ("interface", rf"(?:export\s+)?interface\s+{_ID}"), ("type", rf"(?:export\s+)?type\s+{_ID}\s*[=<]"), ("enum", rf"(?:export\s+)?(?:const\s+)?enum\s+{_ID}"), ("function", rf"(?:export\s+)?const\s+{_ID}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("constant", rf"(?:export\s+)?(?:const|let|var)\s+{_ID}"), ("export", r"export\b()")]),
    "go": ("brace", [("import", r"import\b()"), ("method", rf"func\s+\([^)]*\)\s*{_ID}"), ("function", rf"func\s+{_ID}"), ("struct", rf"type\s+{_ID}\s+struct"), ("interface", rf"type\s+{_ID}\s+interface"), ("type", rf"type\s+{_ID}"), ("constant", rf"(?:const|var)\s+{_ID}")]),
    "java": ("brace", [("import", r"import\s+([\w.*]+)"), ("class", rf"(?:(?:public|private|protected|abstract|final|static)\s+)*class\s+{_ID}"), ("interface", rf"(?:(?:public|private|protected)\s+)*interface\s+{_ID}"), ("enum", rf"(?:(?:public|private|protected)\s+)*enum\s+{_ID}")]),
    "c": ("brace", [("import", r"#include\s*([<\"][^>\"]+[>\"])"), ("macro", rf"#define\s+{_ID}\("), ("constant", rf"#define\s+{_ID}"), ("struct", rf"(?:typedef\s+)?struct\s+{_ID}?"), ("enum", rf"(?:typedef\s+)?enum\s+{_ID}?"), ("type", r"typedef\b.*?(\w+)\s*;"), ("function", r"(?!return|else|if|for|while|switch)(?:[\w*]+[\s*]+)+\**(\w+)\s*\([^;]*$")]),
    "ruby": ("end", [("import", r"(?:require|require_relative|load)\s+['\"]([^'\"]+)"), ("class", r"class\s+([\w:]+)"), ("module", r"module\s+([\w:]+)"), ("function", r"def\s+(?:self\.)?([\w?!=]+)"), ("constant", r"([A-Z][A-Z0-9_]+)\s*=")]),
    "lua": ("end", [("function", r"(?:local\s+)?function\s+([\w.:]+)"), ("import", r"local\s+\w+\s*=\s*require\s*\(?['\"]([^'\"]+)"), ("constant", r"(?:local\s+)?([A-Z][A-Z0-9_]+)\s*=")]),
    "cmake": ("paren", [("function", r"(?i)(?:function|macro)\s*\(\s*(\w+)"), ("module", r"(?i)add_(?:executable|library|custom_target)\s*\(\s*([\w${}-]+)"), ("import", r"(?i)find_\w+\s*\(\s*(\w+)"), ("constant", r"(?i)(?:set|option)\s*\(\s*(\w+)"), ("export", r"(?i)target_\w+\s*\(\s*([\w${}-]+)"), ("section", r"(?i)(?:if|foreach|while)\s*\(()")]),
    "qml": ("brace", [("import", r"import\s+([\w.]+)"), ("class", r"([A-Z]\w*)\s*\{"), ("function", rf"function\s+{_ID}"), ("constant", r"(?:readonly\s+)?property\s+\w+\s+(\w+)")]),
    "meson": ("paren", [("module", r"(?:executable|library|shared_library|static_library|custom_target)\s*\(\s*'([^']+)'"), ("import", r"(\w+)\s*=\s*dependency\b"), ("constant", r"(\w+)\s*=")]),
}
_RULES["javascript"] = _RULES["typescript"]
_RULES["cpp"] = ("brace", [("module", rf"namespace\s+{_ID}?"), ("class", rf"(?:template\s*<[^>]*>\s*)?class\s+{_ID}"), ("type", rf"using\s+{_ID}\s*="), *_RULES["c"][1]])
#: Members of containers, by language.
_MEMBERS = {
    "rust": [("method", rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe)\s+)*fn\s+{_ID}"), ("constant", rf"(?:pub\s+)?const\s+{_ID}"), ("type", rf"type\s+{_ID}")],
    "typescript": [("method", rf"(?:(?:public|private|protected|static|async|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b){_ID}\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{{]+)?\{{"), ("constant", rf"(?:(?:public|private|protected|static|readonly)\s+)*{_ID}\s*(?::[^=]+)?=")],
    "java": [("method", rf"(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)+(?:<[^>]+>\s*)?[\w<>\[\], .?]*?\b{_ID}\s*\([^;]*$"), ("constant", rf"(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], ]+\s+{_ID}\s*[=;]")],
    "ruby": [("method", r"def\s+(?:self\.)?([\w?!=]+)")],
    "cpp": [("method", r"(?!return|else|if|for|while|switch)(?:[\w*&:<>]+[\s*&]+)+(\w+)\s*\([^;]*$")],
}
_MEMBERS["javascript"] = _MEMBERS["typescript"]
_CONTAINERS = ("class", "impl", "trait", "interface", "module", "struct")
_QUIET = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`|//.*$|/\*.*?\*/")
_OPENS = re.compile(r"^\s*(?:local\s+)?(?:function|def|class|module|if|unless|while|until|for|case|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*function\b")


def body_end(lines: list[str], at: int, how: str) -> int:
    """The last line of the declaration that begins on line `at`."""
    depth, seen = 0, False
    for k in range(at, len(lines)):
        if how == "end":
            line = re.sub(r"\"[^\"]*\"|'[^']*'|(?:#|--).*$", "", lines[k])
            depth += bool(_OPENS.search(line)) - len(re.findall(r"\bend\b", line))
            if depth <= 0:
                return k
            continue
        line = _QUIET.sub("", lines[k])
        opening, closing = ("{", "}") if how == "brace" else ("(", ")")
        depth += line.count(opening) - line.count(closing)
        seen = seen or opening in line
        if seen and depth <= 0:
            return k
        if not seen and (how == "paren" or line.rstrip().endswith(";") or k > at and not line.strip()):
            return k if line.strip() else k - 1
    return len(lines) - 1


def by_rules(language: str) -> Chunker:
    how, rules = _RULES[language]
    top = [(kind, re.compile(r"\s*" + p.removeprefix("(?i)"), re.I if p.startswith("(?i)") else 0)) for kind, p in rules]
    inner = [(kind, re.compile(r"\s+" + p)) for kind, p in _MEMBERS.get(language, [])]
    single = ("import", "constant", "type") if language != "go" else ()

    def run(lines: list[str]) -> list[Chunk]:
        out, k = [], 0
        while k < len(lines):
            line = lines[k]
            hit = next(((kind, m) for kind, p in top if (m := p.match(line))), None) if line[:1].strip() or language in ("cmake", "meson", "qml") else None
            if not hit:
                k += 1
                continue
            kind, m = hit
            grouped = kind == "import" and "(" in line and ")" not in line
            if language == "go":
                end = body_end(lines, k, "paren" if grouped or kind == "constant" and "(" in line else "brace") if "{" in line or "(" in line else k
            elif kind in single and not line.rstrip().endswith(("{", "[", "(")):
                end = k
            else:
                end = body_end(lines, k, how)
            end = max(end, k)
            out.append(Chunk(kind, m[1] or None, k, end, flags={"public": "true"} if line.lstrip().startswith(("pub", "public", "export")) else {}))
            if kind in _CONTAINERS:
                j = k + 1
                while j <= end:
                    sub = next(((a, n) for a, p in inner if (n := p.match(lines[j]))), None)
                    if not sub:
                        j += 1
                        continue
                    last = min(body_end(lines, j, how), end) if sub[0] == "method" else j
                    out.append(Chunk(sub[0], sub[1][1], j, max(last, j)))
                    j = max(last, j) + 1
            k = end + 1
        return out

    return run


# --- documents and data ----------------------------------------------------------
def markdown(lines: list[str]) -> list[Chunk]:
    """Sections under headings, as documents, and fenced blocks, as code."""
    out, fence, start, title = [], None, 0, None
    for k, line in enumerate([*lines, None]):
        if line is not None and re.match(r"\s*(```|~~~)", line):
            if fence is None:
                fence = (k, line.strip().strip("`~").strip())
            else:
                out.append(Chunk("section", f"{title or 'code'} [{fence[1] or 'text'}]", fence[0], k, 0.3))
                fence = None
        elif line is None or fence is None and re.match(r"#{1,6} ", line):
            if k > start:
                out.append(Chunk("document_section", title, start, k - 1, 0.3, "document"))
            if line is not None:
                start, title = k, line.lstrip("#").strip()
    return out


class _Html(HTMLParser):
    """Elements to a depth, with the lines they span."""

    void = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, depth: int):
        super().__init__()
        self.depth, self.open, self.found = depth, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.void:
            return
        given = dict(attrs)
        self.open.append((tag, given.get("id") or given.get("class") or tag, self.getpos()[0] - 1))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if k < self.depth:
                    self.found.append((k, *self.open[k], self.getpos()[0] - 1))
                del self.open[k:]
                return


def html(lines: list[str]) -> list[Chunk]:
    p = _Html(5)
    p.feed("\n".join(lines))
    p.close()
    kinds = {"html": "module", "head": "module", "body": "module"} | dict.fromkeys(("header", "nav", "main", "section", "article", "aside", "footer", "form"), "struct")
    return [Chunk(kinds.get(tag, "section"), name, a, b, 0.6 - 0.1 * min(depth, 4)) for depth, tag, name, a, b in sorted(p.found, key=lambda x: (x[3], x[0]))]


def css(lines: list[str]) -> list[Chunk]:
    out, k = [], 0
    while k < len(lines):
        if "{" in lines[k]:
            end = body_end(lines, k, "brace")
            name = lines[k].split("{")[0].strip() or None
            at = (name or "").startswith("@")
            out.append(Chunk("module" if at else "struct", name, k, end, 0.6 if at or end - k > 20 else 0.4))
            k = end
        k += 1
    return out


def json_pairs(lines: list[str]) -> list[Chunk]:
    """Pairs to depth 2; deeper and shorter ones matter less."""
    out, stack, depth = [], [], 0
    for k, line in enumerate(lines):
        m = re.match(r"\s*\"((?:\\.|[^\"\\])*)\"\s*:", line)
        quiet = re.sub(r"\"(?:\\.|[^\"\\])*\"", "", line)
        grow = quiet.count("{") + quiet.count("[") - quiet.count("}") - quiet.count("]")
        if m and depth in (1, 2):
            if grow > 0:
                stack.append((m[1], k, depth))
            else:
                out.append(Chunk("constant", m[1], k, k, 0.5 if depth == 1 else 0.3))
        depth += grow
        while stack and depth <= stack[-1][2]:
            name, start, d = stack.pop()
            out.append(Chunk("constant", name, start, k, (0.6 if k - start > 10 else 0.5) if d == 1 else 0.4))
    return sorted(out, key=lambda c: (c.start, -c.end))


def yaml_pairs(lines: list[str]) -> list[Chunk]:
    """Mapping pairs to depth 2, by indentation."""
    out, tops = [], []
    for k, line in enumerate(lines):
        m = re.match(r"( *)([\w.\-/\"']+)\s*:(?:\s|$)", line)
        if m:
            tops.append((k, len(m[1]), m[2].strip("\"'")))
    widths = sorted({w for _, w, _ in tops})[:2]
    for i, (k, w, name) in enumerate(tops):
        if w in widths:
            after = next((j for j, v, _ in tops[i + 1 :] if v <= w), len(lines))
            end = after - 1
            while end > k and not lines[end].strip():
                end -= 1
            out.append(Chunk("constant", name, k, end, 0.5 if w == 0 else 0.4))
    return out


def toml_tables(lines: list[str]) -> list[Chunk]:
    heads = [(k, line.strip().strip("[]")) for k, line in enumerate(lines) if re.match(r"\s*\[+[^\]]+\]+\s*(?:#.*)?$", line)]
    out = []
    for i, (k, name) in enumerate(heads):
        end = (heads[i + 1][0] if i + 1 < len(heads) else len(lines)) - 1
        while end > k and not lines[end].strip():
            end -= 1
        out.append(Chunk("module", name, k, end, 0.6))
    first = heads[0][0] if heads else len(lines)
    out += [Chunk("constant", m[1], k, k, 0.4) for k, line in enumerate(lines[:first]) if (m := re.match(r"\s*([\w.-]+)\s*=", line))]
    return out


def by_lines(lines: list[str]) -> list[Chunk]:
    """Sections that open at declarations or after 50 lines."""
    out, start = [], 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or k - start >= SECTION_LINES or lines[k].lstrip().startswith(PREFIXES):
            name = lines[start].strip()
            out.append(Chunk("section", name if 0 < len(name) < 80 else None, start, k - 1))
            start = k
    return out


CHUNKERS: dict[str, Chunker] = {"python": python, "markdown": markdown, "html": html, "css": css, "less": css, "json": json_pairs, "yaml": yaml_pairs, "toml": toml_tables} | {x: by_rules(x) for x in _RULES}


def register(language: str, chunker: Chunker) -> None:
    """Takes a chunker for a language in place of the own one, in this process; pass it to `chunks` for tasks."""
    CHUNKERS[language] = chunker


def with_gaps(lines: list[str], found: list[Chunk]) -> list[Chunk]:
    """The chunks and, of lines that none claims, sections of at most 50 lines; blank ones are left out."""
    claimed = [False] * len(lines)
    for c in found:
        for k in range(c.start, min(c.end + 1, len(lines))):
            claimed[k] = True
    out, start = list(found), None
    for k in range(len(lines) + 1):
        free = k < len(lines) and not claimed[k]
        if free and start is None:
            start = k
        if start is not None and (not free or k - start == SECTION_LINES):
            if any(x.strip() for x in lines[start:k]):
                out.append(Chunk("section", None, start, k - 1))
            start = k if free else None
    return sorted(out, key=lambda c: (c.start, -c.end))


def chunk_text(text: str | None, language: str | None, extra: dict[str, Chunker] | None = None) -> list[Chunk]:
    """The chunks of a file; by lines where its language has no chunker or doesn't parse; none of an empty text."""
    if not text:
        return []
    lines = text.replace("\r\n", "\n").split("\n")
    chunker = (CHUNKERS | (extra or {})).get(language or "", by_lines)
    try:
        found = chunker(lines)
    except (SyntaxError, ValueError, RecursionError):
        found = by_lines(lines)
    return with_gaps(lines, found)


def chunks(files: DataFrame, extra: dict[str, Chunker] | None = None) -> DataFrame:
    """The chunks of files (path, language, content), as SCHEMA has them, with an id from path, line and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, text in zip(pdf.path.tolist(), pdf.language.tolist(), pdf.content.tolist()):
                lines = (text or "").replace("\r\n", "\n").split("\n")
                for c in chunk_text(text, language, extra):
                    body = "\n".join(lines[c.start : c.end + 1])
                    first = next((x.strip() for x in lines[c.start : c.end + 1] if x.strip() and not x.strip().startswith(("@", "#[", "//", "/*", "*"))), "")
                    signature = first if c.kind in ("function", "method", "class", "struct", "enum", "trait", "interface", "impl") and len(first) <= 120 else None
                    meta = c.flags | ({"context_before": "\n".join(lines[max(0, c.start - 3) : c.start])} if c.start else {})
                    rows.append((path, language, c.kind, c.name, signature, c.start, c.end, body, hashlib.sha256(body.encode()).hexdigest(), c.importance if c.importance is not None else PRIORS.get(c.kind, 0.5), c.source_type, meta))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in re.sub(r"map<[^>]*>", "m", SCHEMA).split(", ")])

    out = files.select("path", "language", "content").mapInPandas(run, SCHEMA)
    return out.withColumn("id", F.xxhash64("file_path", "line_start", "line_end", "content_hash"))
