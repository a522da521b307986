"""Functions paired with their documentation (problem 7).

Signatures are found by regular expressions per language.  Bodies end where the
indentation falls back, where a stack of end keywords empties, or where the
braces close.  A comment belongs to a declaration if no empty line lies between;
decorators, attributes and annotations may.  Python docstrings count as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunk types that hold functions.
KINDS = ("function", "method", "section")

_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|else|do|new|function|with|elif|until|case|await|throw|typeof|sizeof|delete|in|of|match|loop|unless|super|import|export)\b)"
_JS = re.compile(
    r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:"
    r"(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<a>[\w$]+)[ \t]*(?:<[^>\n]*>)?\("
    rf"|(?:const|let|var)[ \t]+(?P<b>[\w$]+)(?:[ \t]*:[^=\n]+)?[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)[ \t]*(?::[^=\n]+)?=>)"
    rf"|(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)[ \t]+)*\*?{_NOT_NAMES}(?P<c>#?[\w$]+)[ \t]*(?:<[^>\n]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)[ \t]*(?::[^{{\n]+)?\{{"
    r")",
    re.M,
)
_SIGNATURES = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<a>\w+)[ \t]*[(\[]", re.M),
    "javascript": _JS,
    "typescript": _JS,
    "rust": re.compile(r'^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+"[^"]*")?)[ \t]+)*fn[ \t]+(?P<a>\w+)', re.M),
    "go": re.compile(r"^func[ \t]+(?:\([^)]*\)[ \t]*)?(?P<a>\w+)[ \t]*[(\[]", re.M),
    "java": re.compile(rf"^[ \t]*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*(?:<[^>\n]+>[ \t]+)?{_NOT_NAMES}(?:[\w.]+(?:<[^()\n;=]*>)?(?:\[\])*[ \t]+)(?P<a>{_NOT_NAMES}\w+)[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*\)[ \t]*(?:throws[ \t]+[\w., \t]+)?\s*\{{", re.M),
    "c": re.compile(rf"^(?:(?:static|inline|extern|const|unsigned|signed|struct|enum|long|short)[ \t]+)*{_NOT_NAMES}\w+[ \t*]+(?:[ \t*]*\b(?:const|int|char|long)\b[ \t*]*)*(?P<a>{_NOT_NAMES}\w+)[ \t]*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*\{{", re.M),
    "ruby": re.compile(r"^[ \t]*(?:(?:private|public|protected|module_function)[ \t]+)?def[ \t]+(?:self\.)?(?P<a>\w+[?!=]?)", re.M),
    "lua": re.compile(r"^[ \t]*(?:(?:local[ \t]+)?function[ \t]+(?P<a>[\w.:]+)[ \t]*\(|(?:local[ \t]+)?(?P<b>[\w.]+)[ \t]*=[ \t]*function[ \t]*\()", re.M),
    "shell": re.compile(r"^[ \t]*(?:function[ \t]+(?P<a>[\w:.-]+)[ \t]*(?:\(\)[ \t]*)?\{?[ \t]*$|(?P<b>[\w:.-]+)[ \t]*\(\)[ \t]*\{?)", re.M),
}
_SIGNATURES["cpp"] = _SIGNATURES["c"]
_SIGNATURES |= {
    "csharp": re.compile(rf"^[ \t]*(?:(?:public|protected|private|internal|static|virtual|override|abstract|sealed|async|partial|extern|unsafe|new|readonly)[ \t]+)*{_NOT_NAMES}(?:[\w.]+(?:<[^()\n;=]*>)?\??(?:\[,*\])*\??[ \t]+)(?P<a>{_NOT_NAMES}\w+)[ \t]*(?:<[^>\n]+>)?[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*\)[^;{{}}=]*(?:\{{|=>)", re.M),
    "kotlin": re.compile(r"^[ \t]*(?:(?:public|private|protected|internal|open|override|abstract|final|suspend|inline|tailrec|operator|infix|external|actual|expect)[ \t]+)*fun[ \t]+(?:<[^>\n]+>[ \t]*)?(?:[\w.]+(?:<[^>\n]*>)?\??\.)?(?P<a>\w+)[ \t]*\(", re.M),
    "swift": re.compile(r"^[ \t]*(?:(?:public|private|fileprivate|internal|open|static|class|final|override|mutating|nonmutating|required|convenience)[ \t]+)*func[ \t]+(?P<a>\w+)[ \t]*(?:<[^>\n]+>)?[ \t]*\(", re.M),
    "php": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|abstract|final)[ \t]+)*function[ \t]+&?(?P<a>\w+)[ \t]*\(", re.M),
    "scala": re.compile(r"^[ \t]*(?:(?:private(?:\[\w+\])?|protected|override|final|implicit|inline|lazy)[ \t]+)*def[ \t]+(?P<a>\w+)", re.M),
    "dart": re.compile(rf"^[ \t]*(?:(?:static|external|abstract|final|covariant)[ \t]+)*{_NOT_NAMES}(?:[\w.]+(?:<[^()\n;=]*>)?\??[ \t]+)(?P<a>{_NOT_NAMES}\w+)[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*\)[ \t]*(?:async\*?[ \t]*|sync\*[ \t]*)?(?:\{{|=>)", re.M),
}
#: Languages in which a body may be an expression without braces.
_EXPRESSIONS = ("csharp", "kotlin", "scala", "dart")
#: File name endings of languages, where the language is missing.
_ENDINGS = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "rb": "ruby", "lua": "lua", "sh": "shell", "bash": "shell", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "php": "php", "scala": "scala", "dart": "dart"}

#: Marks that begin a comment line, by language.
_LINE_COMMENT = {"python": "#", "ruby": "#", "shell": "#", "lua": "--"}
_DECORATOR = {
    "python": re.compile(r"@\w"),
    "java": re.compile(r"@(?!interface\b)\w"),
    "javascript": re.compile(r"@\w"),
    "typescript": re.compile(r"@\w"),
    "rust": re.compile(r"#!?\["),
    "c": re.compile(r"\[\[|__attribute__|#pragma\b|template\b"),
    "go": re.compile(r"//go:"),
    "ruby": re.compile(r"(?:private|public|protected|memoize|sig)\b[^=(]*$"),
}
_DECORATOR["cpp"] = _DECORATOR["c"]
_DECORATOR |= {"csharp": re.compile(r"\["), "php": re.compile(r"#\[")} | dict.fromkeys(("kotlin", "swift", "scala", "dart"), _DECORATOR["java"])
_DOCSTRING = re.compile(r"\s*(?:#[^\n]*\n\s*)*[rRuUbB]{0,2}(\"\"\"|'''|\"|')")
_BLOCKS = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_TRIPLE = re.compile(r"(\"\"\"|''').*?(?:\1|\Z)", re.S)
_LONG_LUA = re.compile(r"--\[(=*)\[.*?(?:\]\1\]|\Z)", re.S)


def language_of(language: str | None, path: str | None) -> str | None:
    """The language by its name or, if that is none of the known, by the file's ending."""
    name = (language or "").strip().lower()
    if name in _SIGNATURES:
        return name
    return _ENDINGS.get((path or "").rstrip().rsplit(".", 1)[-1].lower())


def declarations(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end of the match, name) of each declaration outside comments and long strings."""
    hidden: list[tuple[int, int]] = []
    if language == "python":
        hidden = [m.span() for m in _TRIPLE.finditer(text)] if '"""' in text or "'''" in text else []
    elif language == "lua":
        hidden = [m.span() for m in _LONG_LUA.finditer(text)] if "--[" in text else []
    elif language not in ("ruby", "shell"):
        hidden = [m.span() for m in _BLOCKS.finditer(text)] if "/*" in text else []
    out = []
    for m in _SIGNATURES[language].finditer(text):
        name = next((g for g in m.groups() if g), None)
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        if name and not any(a <= at < b for a, b in hidden):
            out.append((at, m.end(), name))
    return out


def _is_comment(line: str, language: str) -> bool:
    mark = _LINE_COMMENT.get(language, "//")
    return line.startswith(mark) and not (language == "rust" and line.startswith("#"))


def comment_above(lines: list[str], at: int, language: str) -> list[str]:
    """The comment lines directly above line `at`; decorators may lie between, empty lines not."""
    decorator = _DECORATOR.get(language)
    found: list[str] = []
    k = at - 1
    while k >= 0:
        line = lines[k].strip()
        if not line:
            break
        if decorator and decorator.match(line):
            if found and language != "go":
                break
            k -= 1
            continue
        if _is_comment(line, language):
            found.append(line)
            k -= 1
            continue
        if line.endswith("*/") and language not in _LINE_COMMENT or line.endswith("]]") and language == "lua":
            opening = "/*" if language != "lua" else "--["
            if found:
                break
            while k >= 0:
                found.append(lines[k].strip())
                if opening in lines[k]:
                    break
                k -= 1
            else:
                return []
            if not lines[max(k, 0)].strip().startswith(opening):
                return []
            break
        if decorator and not found and line[-1] in ")]" and language not in ("c", "cpp", "go", "ruby"):
            start = _decorator_start(lines, k, decorator)
            if start is not None:
                k = start - 1
                continue
        break
    return found[::-1]


def _decorator_start(lines: list[str], at: int, decorator: re.Pattern) -> int | None:
    """The first line of a decorator over several lines that ends at line `at`."""
    depth = 0
    for k in range(at, -1, -1):
        line = lines[k]
        if not line.strip():
            return None
        depth += sum(line.count(c) for c in ")]}") - sum(line.count(c) for c in "([{")
        if depth <= 0:
            return k if k < at and decorator.match(line.strip()) else None
    return None


def docstring(text: str, after: int) -> list[str]:
    """The lines of a Python docstring; `after` is the place after the opening bracket of the parameters."""
    depth, k, n = 1, after, len(text)
    while k < n and depth:
        c = text[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in "\"'":
            end = text.find(c, k + 1)
            k = end if end > 0 else k
        elif c == "#":
            k = text.find("\n", k) if text.find("\n", k) > 0 else n
        k += 1
    colon = re.compile(r"[^\n:]*:").match(text, k)
    if not colon:
        return []
    m = _DOCSTRING.match(text, colon.end())
    if not m:
        return []
    end = text.find(m[1], m.end())
    return text[m.end() : end if end >= 0 else n].split("\n")


_MARKS = re.compile(r"^\s*(?:/\*[*!]*|//[/!]*|\*+/?|#+!?|--\[=*\[|-{2,})\s?|\s*(?:\*+/|\]=*\])\s*$")
_TAG = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|tparam|property|prop|throws?|exception|raises?|typeparam|field)\s*(?:\{[^}]*\}\s*)?(?:\[?[\w.$*]+\]?)?|[@\\](?:returns?|yields?|brief|details?|summary|description|see|since|deprecated|note)\s*(?:\{[^}]*\})?|:(?:param|type|raises?|arg|keyword|var)\s+[\w.* ]+:|:(?:returns?|rtype|yields?):|[@\\]\w+(?:\([^)]*\))?)\s*[-:]?\s*")
_HEADING = re.compile(r"^\s*(?:#+\s*)?(?:args|arguments|parameters|params|returns?|raises|yields|errors|panics|safety|examples?|notes?|throws|attributes)\s*:?\s*$", re.I)
_ARGUMENT = re.compile(r"^\s*\*{0,2}[\w.$]+(?:\s*\([^)]*\))?\s*:\s+")
#: Instructions to tools.
_DIRECTIVE = re.compile(
    r"^\s*(?:eslint(?:-\w+)*\b|tslint:|jshint\b|jscs:|noqa\b|nolint\b|nosec\b|nosonar\b|fmt:\s*(?:skip|off|on)|rustfmt::|clippy::|rubocop:|pylint:|flake8:|mypy:|pyright:|ruff:|isort:|yapf:|black:|type:\s*ignore|pragma:?\s|prettier-ignore|@?ts-(?:ignore|nocheck|expect-error)|clang-(?:format|tidy)\b|shellcheck\b|luacheck:|stylua:|istanbul\b|c8\s+ignore|v8\s+ignore|coverage:|checkstyle[:\s]|spotless:|@formatter:|go:\w+|\+build\b|cspell:|spell-?checker:|codespell|sourcery|deepsource|lint:|\$FlowFixMe|@flow\b|vim?:|-\*-)",
    re.I,
)
_NOTE = re.compile(r"^\s*(?:TODO|FIXME|XXX|HACK|TBD|WIP|BUG|OPTIMIZE)\b\s*(?:\([^)]*\))?\s*:?[^.!?。]*(?:[.!?。]+\s*|$)")
_CODE = re.compile(r"^\s*(?:return\b\s*[\w.]+\s*[\[(.;]|return\s*;?\s*$|(?:const|let|var|local|if|elif|else|for|while|int|char|void|print|import|from|use|fn|def|func|end)\b[^.]*[;{}):]\s*$|[\w.\[\]]+\s*(?:[-+*/|&]|:|\?\?)?=(?!=)\s*\S|[\w.:]+\([^)]*\)\s*;?\s*$|.*[;{}]\s*$)")
#: Phrases that stand where a description should.
_PLACEHOLDER = re.compile(r"^\W*(?:(?:no|missing|add|insert|write|needs?|todo|awaiting|pending)\s+(?:a\s+|the\s+|some\s+|any\s+|proper\s+)?(?:description|documentation|docs?|docstring|javadoc|comments?)\b[^.]{0,30}|(?:description|documentation|docs?|docstring)\s+(?:goes|comes|to\s+be|will\s+be|is)\s+(?:here|later|added|missing|written|follow\w*)[^.]{0,30}|not\s+documented\b[^.]{0,20}|see\s+(?:above|below|there|the\s+code)|same\s+as\s+above|lorem\s+ipsum.*|to\s+be\s+(?:done|documented|written)[^.]{0,20}|document\s+me|self[\s-]explanatory|auto-?generated\s+(?:method|function)?\s*(?:stub|comment|docstring))\W*$", re.I)
#: Words that say nothing beside the function's name.
_FILLERS = frozenset("this that the a an function functions func method methods procedure routine helper will does do is are be it its to of for and in on which just simply here used use uses performs perform implements implementation implement executes execute called call calls when with code".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


def cleaned(doc: list[str]) -> list[str]:
    """The doc's lines without comment marks."""
    out = []
    for line in doc:
        before = None
        while before != line:
            before, line = line, _MARKS.sub("", line)
        out.append(line.strip())
    return out


def saying(doc: list[str]) -> list[str]:
    """What cleaned lines say, without tags and names after them, tool directives, notes and disabled code."""
    out = []
    in_arguments = False
    for line in doc:
        if not line or _DIRECTIVE.match(line):
            continue
        if _HEADING.match(line):
            in_arguments = True
            continue
        line = _TAG.sub("", line)
        if in_arguments:
            line = _ARGUMENT.sub("", line)
        line = _NOTE.sub("", line) if _NOTE.match(line) else line
        if line and not _CODE.match(line) and not _PLACEHOLDER.match(line) and _WORD.search(line):
            out.append(line)
    return out


def trivial(doc: list[str], name: str) -> bool:
    """Whether cleaned lines say nothing: fewer than four words, or only the function's name and fillers."""
    text = " ".join(saying(doc))
    if len(_CJK.findall(text)) >= 6:
        return False
    words = [w.lower() for w in _WORD.findall(text)]
    if len(words) < 4 or _PLACEHOLDER.match(text):
        return True
    own = {p.lower() for p in _PARTS.findall(name)} | {name.lower()}
    own |= {p + s for p in own for s in ("s", "es", "ing", "ed")} | {p[:-1] + s for p in own if p.endswith("e") for s in ("ing", "ed")}
    flat = name.lower().replace("_", "")
    return all(w in own or w in _FILLERS or w == flat for w in words)


def body_end(lines: list[str], at: int, language: str) -> int:
    """The line after the body of the declaration on line `at`."""
    indent = len(lines[at]) - len(lines[at].lstrip())
    if language == "python":
        k, opened = at, 0
        while k < len(lines):
            opened += sum(lines[k].count(c) for c in "([{") - sum(lines[k].count(c) for c in ")]}")
            k += 1
            if opened <= 0:
                break
        last = k
        while k < len(lines):
            if lines[k].strip():
                if len(lines[k]) - len(lines[k].lstrip()) <= indent:
                    break
                last = k + 1
            k += 1
        return last
    if language in ("ruby", "lua"):
        opener = re.compile(r"^\s*(?:local\s+)?(?:function|def|if|unless|while|until|for|case|begin|class|module)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*function\b|\bfunction\s*\([^)]*\)\s*$")
        depth = 0
        for k in range(at, len(lines)):
            line = re.sub(r"\"[^\"]*\"|'[^']*'", "", lines[k].split("--" if language == "lua" else " #")[0])
            depth += 1 if opener.search(line) else 0
            depth -= len(re.findall(r"\bend\b", line))
            if depth <= 0:
                return k + 1
        return len(lines)
    depth, seen, parens = 0, False, 0
    for k in range(at, len(lines)):
        line = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`|//.*$", "", lines[k])
        parens += line.count("(") - line.count(")")
        depth += line.count("{") - line.count("}")
        seen = seen or "{" in line
        if seen and depth <= 0:
            return k + 1
        if not seen and line.rstrip().endswith(";"):
            return k + 1
        if not seen and language in _EXPRESSIONS and parens <= 0:
            below = next((x for x in lines[k + 1 :] if x.strip()), "")
            if len(below) - len(below.lstrip()) <= indent and not below.lstrip().startswith(("{", "=", ":", "where")):
                return k + 1
    return len(lines)


def functions(text: str | None, language: str | None, path: str | None = None) -> Iterator[tuple[str, int, str, str, bool]]:
    """(name, 1-based line, documentation, code, trivial) of each declared function that has any documentation."""
    name_of = language_of(language, path)
    if not text or not name_of:
        return
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    found = declarations(text, name_of)
    if not found:
        return
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    row = 0
    for at, end, name in found:
        while starts[row + 1] <= at:
            row += 1
        docs = [comment_above(lines, row, name_of)]
        if name_of == "python":
            docs.append(docstring(text, end))
        docs = [d for d in map(cleaned, docs) if any(d)]
        if docs:
            good = [d for d in docs if not trivial(d, name)]
            yield name, row + 1, "\n".join((good or docs)[0]).strip(), "\n".join(lines[row : body_end(lines, row, name_of)]), not good


def pairs(chunks: DataFrame) -> DataFrame:
    """chunk_id, func_name, line_no, documentation, code of each documented function.

    line_no is the 1-based line of the declaration, so that functions of one name
    in a chunk stay apart.  Chunks of the types in KINDS, deleted ones included.
    Null or empty texts and unknown languages have no functions.  Repeated rows
    of a chunk give one row a function.  Functions whose documentation is missing
    or trivial are dropped.
    """
    schema = "chunk_id long, func_name string, line_no int, documentation string, code string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, language, path, text in zip(pdf.id.tolist(), pdf.language.tolist(), pdf.file_path.tolist(), pdf.content_raw.tolist()):
                rows += [(i, *x) for *x, dull in functions(text, language, path) if not dull]
            yield pd.DataFrame(rows, columns=["chunk_id", "func_name", "line_no", "documentation", "code"])

    some = chunks.where(F.col("chunk_type").isin(*KINDS) & F.col("content_raw").isNotNull() & F.col("id").isNotNull())
    out = some.select("id", "language", "file_path", "content_raw").mapInPandas(run, schema)
    return out.dropDuplicates(["chunk_id", "func_name", "line_no"])


def skipped(chunks: DataFrame) -> DataFrame:
    """language, chunks: how many chunks of the types in KINDS are in a language without signatures."""
    known = F.lower(F.trim(F.coalesce("language", F.lit("")))).isin(*_SIGNATURES) | F.lower(F.regexp_extract(F.rtrim("file_path"), r"\.([^.]*)$", 1)).isin(*_ENDINGS)
    some = chunks.where(F.col("chunk_type").isin(*KINDS) & F.col("content_raw").isNotNull() & F.col("id").isNotNull() & ~F.coalesce(known, F.lit(False)))
    return some.groupBy(F.lower(F.trim("language")).alias("language")).agg(F.countDistinct("id").alias("chunks"))
