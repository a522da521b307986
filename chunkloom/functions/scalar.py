"""Column expressions: hashing, names, scores and sizes.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Importance priors of chunk types.
PRIORS = {
    "function": 0.9, "method": 0.9, "class": 0.85, "interface": 0.85, "trait": 0.85, "impl": 0.8, "enum": 0.8, "struct": 0.8,
    "type": 0.7, "macro": 0.7, "constant": 0.6, "export": 0.6, "module": 0.5, "import": 0.3, "section": 0.2, "fact": 0.7,
    "decision": 0.8, "preference": 0.75, "summary": 0.6, "entity_description": 0.65, "document_section": 0.5,
}

#: Languages by file name ending.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python",
    "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "lua": "lua",
    "sh": "shell", "bash": "shell", "zsh": "shell", "html": "html", "htm": "html", "css": "css", "scss": "scss", "less": "less", "json": "json", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "md": "markdown", "markdown": "markdown", "sql": "sql", "kt": "kotlin", "swift": "swift", "cs": "csharp", "php": "php",
    "dart": "dart", "scala": "scala", "hs": "haskell", "ex": "elixir", "exs": "elixir", "zig": "zig", "xml": "xml", "graphql": "graphql", "gql": "graphql",
    "proto": "protobuf", "cmake": "cmake", "qml": "qml", "ini": "ini",
}

#: Languages by whole file name.
FILE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake", "meson.build": "meson", "gemfile": "ruby", "rakefile": "ruby"}


def _lookup(table: dict[str, object], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def prior(chunk_type: Column) -> Column:
    """The importance prior of a chunk type; null for an unknown one."""
    return _lookup(PRIORS, chunk_type)


def language(path: Column) -> Column:
    """The language of a path by file name, then by ending; null if unknown."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ending = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(name.startswith(".env"), "dotenv").otherwise(F.coalesce(_lookup(FILE_NAMES, name), _lookup(LANGUAGES, ending)))


def content_hash(content: Column) -> Column:
    """Hexadecimal SHA-256."""
    return F.sha2(content, 256)


def canonical(name: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=.)([A-Z])", "_$1"))


def name_words(name: Column) -> Column:
    """A symbol's name as a query: parts by underscore and other marks, lower case, blanks between; the index does not split by case either."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """Estimated model tokens: 10 of 36 bytes, rounded up."""
    return F.ceil(F.octet_length(text) * 10 / 36)


def recency(updated_at: Column, as_of: Column) -> Column:
    """2^(-days/90); 1 for a null time."""
    days = F.greatest((F.unix_micros(as_of) - F.unix_micros(updated_at)) / 86_400_000_000.0, F.lit(0.0))
    return F.coalesce(F.pow(F.lit(2.0), -days / 90), F.lit(1.0))


def importance_boost(score: Column, importance: Column) -> Column:
    return score * (F.lit(0.95) + F.lit(0.05) * importance)


def source_key(name: Column, path: Column) -> Column:
    """What results are diversified by: the session of a conversation fact, else the file."""
    parts = F.split(name, ":")
    session = F.concat_ws(":", parts[1], parts[2])
    return F.when((F.size(parts) >= 3) & parts[0].isin("locomo", "locomo-fact"), session).otherwise(path)


def name_bonus(query_tokens: Column, name: Column, signature: Column) -> Column:
    """Bonus for query tokens of three bytes or more in the name or signature; 0 without a name."""
    long = F.filter(query_tokens, lambda t: F.octet_length(t) > 2)
    low, sig = F.lower(name), F.lower(F.coalesce(signature, F.lit("")))
    in_name = F.size(F.filter(long, lambda t: F.contains(low, t)))
    in_any = F.size(F.filter(long, lambda t: F.contains(low, t) | F.contains(sig, t)))
    loose = F.size(F.filter(long, lambda t: F.contains(low, t) & (F.length(low) > F.length(t) + 2)))
    n = F.size(long)
    in_part, any_part = in_name / n, in_any / n
    bonus = (
        F.when(in_part >= 0.8, 0.4)
        .when(any_part >= 0.8, 0.3)
        .when(in_part >= 0.5, 0.25)
        .when(any_part >= 0.5, 0.15)
        .when(in_name > 0, F.lit(0.12) + F.lit(0.05) * loose)
        .when(in_any > 0, 0.06)
        .otherwise(0.0)
    )
    return F.when(name.isNull() | (n == 0), 0.0).otherwise(bonus)


def name_hit(query_tokens: Column, name: Column) -> Column:
    """Whether any query token of three bytes or more is in the name."""
    return F.coalesce(F.exists(query_tokens, lambda t: (F.octet_length(t) > 2) & F.contains(F.lower(name), t)), F.lit(False))
