"""Generated, minified or vendored source files (problem 5).

Each chunk gives statistics that add up over its file: compressed bytes, token
entropy, identifier lengths, comment lines and a few more, plus what the file's
path says by convention.  Header notices ("do not edit", "vendored from", a
minifier's banner, the opening of a data literal) label the files; they are cut
from the text before the statistics are taken.  A random forest is trained on a
bounded sample of files.

Many such files carry no notice, so "no notice" is an unlabelled class rather
than a negative one: the forest's score estimates how likely a file is to carry
one, and a file is taken if that is far above what hand-written files have.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.common import Scratch, clean_path

#: Files that the forest is trained on, at most.
SAMPLE = 40_000
#: LEAVES: a leaf holds at least one in so many of the files trained on.
TREES, DEPTH, LEAVES, SEED = 60, 8, 400, 7
#: Score from which a file is taken: about five times that of hand-written files.
SCORE = 0.1
#: Characters below which a body tells nothing by itself.
BODY = 60
#: Score from which a configuration file without a notice is taken.
SURE = 0.5

#: Forms of the notices that tools and importers leave at the top of a file.
_GENERATED = r"(?:do not|don'?t|never) (?:hand[- ]?)?(?:edit|modify|change|touch)\b|auto[- ]?generated|automatically generated|machine[- ]generated|@generated\b|code generated by|(?:generated|produced|emitted|built) (?:by|from) \S+.{0,60}(?:do not|don'?t|; run|\bregenerate\b|\binstead\b)|\b(?:edits?|changes?|modifications?)\b.{0,40}\b(?:lost|overwritten|discarded)\b|automatisch erzeugt|nicht von hand|généré automatiquement|ne pas modifier|generado automáticamente|no (?:editar|modificar)|自動生成|自动生成"
_VENDORED = r"\bvendored\b.{0,20}\bfrom\b|\bcopied\b.{0,20}\b(?:verbatim|unchanged|unmodified)\b|\b(?:verbatim|unmodified|bundled|vendored) copy of\b|\bimported\b.{0,20}\b(?:without changes|unchanged|unmodified|verbatim)\b|\bmaintained (?:elsewhere|upstream)\b|\bupstream\b.{0,40}\b(?:in sync|patches)\b|\bv?\d+\.\d+(?:\.\d+)?\b.{0,40}(?:\(c\)|\bcopyright\b).{0,60}\b(?:authors|contributors|foundation|licen[cs]e)\b"
_NOTICE = re.compile(f"{_GENERATED}|{_VENDORED}", re.I)
_BANNER = re.compile(r"^\s*/\*!|//[#@] sourceMappingURL=|^\(\(\)=>\{|^!function\(")
_DATA = re.compile(r"^\s*[A-Za-z_][\w \t.\[\]*:<>]{0,80}=\s*(?:\[\]\w+)?[\[{(]\s*$")
_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|!\[|\[|!/)|/\*|\*|--|;|<!--|\"\"\"|''')")
#: Marks of comments that run over several lines.
_LONG = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"), ("--[[", "]]"))
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_VALUE = re.compile(r"\"[^\"]*\"|-?[\d.]+")
_LITERAL_LINE = re.compile(r"^\s*[\[{(\"']?[\s\d.,xXa-fA-F\"'+/=:{}\[\]()-]*[,;\])}]?\s*$|^\s*[\"'][A-Za-z0-9+/=]{40,}[\"']\s*[,+)]?\s*;?\s*$")

#: Folders that hold copies of other projects.
_THIRD_PARTY = r"(?:^|/)(?:node_modules|bower_components|third_party|third-party|thirdparty|Pods|vendor|externals?|extern|site-packages|jspm_packages|Godeps)/"
_RELEASE_FOLDER = r"(?:^|/)(?:deps|contrib|lib|libs|packages|opt)/[^/]+-(?:\d+\.\d[^/]*|src)/"
#: File name forms of generators and bundlers.
_GENERATED_NAME = r"(?:\.generated\.|\.gen\.|\.pb\.|_pb2?(?:_grpc)?\.|\.g\.\w+$|(?:^|/)zz_generated|(?:^|/)lex\.\w|\.tab\.\w+$|\.lock\.json$|_string\.gen\.|\.designer\.|_generated\.)"
_CONFIGURATION = r"(?i)(?:\.(?:json|ya?ml|toml|ini|cfg|conf|properties|env)$|(?:^|/)\.env)"
_BUNDLED_NAME = r"(?:\.min\.|\.prod\.|[-.]bundle\.|\.bundled\.)"

_SUMS = ("chars", "packed", "tokens", "entropy", "names", "name_chars", "short_names", "numbered_names", "number_tokens", "digits", "blanks", "lines", "comment_lines", "literal_lines", "long_runs", "docs")
FEATURES = ("compression", "token_entropy", "name_length", "short_names", "numbered_names", "number_share", "digit_share", "blank_share", "line_length", "longest_line", "comment_density", "literal_lines", "long_runs", "foreign_folder", "generated_name", "bundled_name", "configuration", "size")


def notice(text: str, first: bool) -> bool:
    """Whether a chunk's leading comments, banner or opening line say that a tool or another project made it."""
    lines = text.split("\n")
    if _BANNER.search(lines[0]) or any(_BANNER.search(x) for x in lines[-2:]):
        return True
    if not first:
        return False
    if any(map(_NOTICE.search, lines[: header(lines)])):
        return True
    if lines[0].rstrip()[-1:] not in ("[", "{", "("):
        return _records(lines)
    body = [x for x in lines[1:] if x.strip()]
    return bool(_DATA.match(lines[0]) or lines[0].strip() in ("[", "{")) and len(body) >= 8 and sum(map(bool, map(_LITERAL_LINE.match, body))) > 0.6 * len(body) or _records(lines)


def _records(lines: list[str]) -> bool:
    """Rows of one form, a record a line."""
    rows = [x for x in lines if x.lstrip().startswith(("{", "["))]
    return len(rows) >= 12 and len(rows) > 0.8 * len(lines) and len({_VALUE.sub("v", r).strip(" ,") for r in rows[1:-1]}) <= 3


def header(lines: list[str]) -> int:
    """How many lines at the top are comments, blank, or inside a comment that runs over several lines."""
    closing = None
    for k, line in enumerate(lines):
        said = line.strip()
        if closing:
            closing = None if closing in said else closing
            continue
        if said and not _COMMENT.match(line):
            return k
        for opening, end in _LONG:
            if said.startswith(opening) and end not in said[len(opening) :]:
                closing = end
    return len(lines)


def without_header(text: str) -> str:
    """The text without leading comments, banners and source map lines."""
    lines = text.split("\n")
    return "\n".join(x for x in lines[header(lines) :] if "sourceMappingURL" not in x)


def statistics(text: str) -> tuple[float, ...]:
    """The sums of _SUMS, and the longest line, of one chunk."""
    body = without_header(text)
    lines = body.split("\n")
    tokens = _TOKEN.findall(body)
    names = [t for t in tokens if t[0].isalpha() or t[0] == "_"]
    counts = Counter(tokens)
    n = len(tokens)
    entropy = -sum(c * math.log2(c / n) for c in counts.values()) if n else 0.0
    chars = len(body)
    return (
        chars,
        len(zlib.compress(body.encode("utf-8", "replace"), 6)) - 8 if chars else 0,
        n,
        entropy,
        len(names),
        sum(map(len, names)),
        sum(1 for x in names if len(x) == 1),
        sum(1 for x in names if len(x) > 2 and x[-1].isdigit()),
        sum(1 for t in tokens if t[0].isdigit()),
        sum(map(str.isdigit, body)),
        sum(map(str.isspace, body)),
        len(lines),
        sum(1 for x in lines if _COMMENT.match(x)),
        sum(1 for x in lines if x.strip() and _LITERAL_LINE.match(x)),
        sum(len(x) for x in re.findall(r"[A-Za-z0-9+/]{48,}", body)),
        1,
        max(map(len, lines)),
    )


def file_features(chunks: DataFrame) -> DataFrame:
    """path, labelled and FEATURES of each file of source_type `code`.

    Paths are taken cleaned.  Only sums leave the tasks that read the texts, so a
    path that holds many rows is combined before the shuffle.  Repeated rows of a
    chunk count once; null texts count as empty; rows with a null path are left out.
    """
    schema = "path string, id long, labelled boolean, " + ", ".join(f"{c} double" for c in _SUMS) + ", longest double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, i, at, text in zip(pdf.path.tolist(), pdf.id.tolist(), pdf.line_start.tolist(), pdf.content_raw.tolist()):
                text = (text or "").replace("\r\n", "\n")
                rows.append((path, i, notice(text, not at or at <= 3), *map(float, statistics(text))))
            yield pd.DataFrame(rows, columns=["path", "id", "labelled", *_SUMS, "longest"])

    code = chunks.where((F.col("source_type") == "code") & F.col("file_path").isNotNull())
    some = code.select(clean_path(F.col("file_path")).alias("path"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("line_start", F.lit(0)).alias("line_start"), "content_raw")
    each = some.mapInPandas(run, schema).groupBy("path", "id").agg(F.max("labelled").alias("labelled"), *[F.max(c).alias(c) for c in (*_SUMS, "longest")])
    total = each.groupBy("path").agg(F.max("labelled").alias("labelled"), F.max("longest").alias("longest"), *[F.sum(c).alias(c) for c in _SUMS])

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), F.lit(0.0))

    def says(pattern: str) -> Column:
        return F.col("path").rlike(pattern).cast("double")

    features = {
        "compression": share("packed", "chars"),
        "token_entropy": share("entropy", "tokens"),
        "name_length": share("name_chars", "names"),
        "short_names": share("short_names", "names"),
        "numbered_names": share("numbered_names", "names"),
        "number_share": share("number_tokens", "tokens"),
        "digit_share": share("digits", "chars"),
        "blank_share": share("blanks", "chars"),
        "line_length": share("chars", "lines"),
        "longest_line": F.col("longest"),
        "comment_density": share("comment_lines", "lines"),
        "literal_lines": share("literal_lines", "lines"),
        "long_runs": share("long_runs", "chars"),
        "foreign_folder": says(f"{_THIRD_PARTY}|{_RELEASE_FOLDER}"),
        "generated_name": says(_GENERATED_NAME),
        "bundled_name": says(_BUNDLED_NAME),
        "configuration": says(_CONFIGURATION),
        "size": F.log1p("chars"),
    }
    return total.select("path", "labelled", *[features[f].alias(f"f_{f}") for f in FEATURES])


def scored(features: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The features and a score from a random forest trained on at most about `sample` of the files.

    The sample is the files of smallest hash, so it does not depend on order or
    partitions and keeps the share of labelled files.  Without both classes
    every score is 0.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    counts = {r["labelled"]: r["count"] for r in features.groupBy("labelled").count().collect()}
    if len(counts) < 2:
        return features.withColumn("score", F.lit(0.0))
    files = sum(counts.values())
    vectors = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(features)
    drawn = F.pmod(F.xxhash64("path"), F.lit(1_000_000)) < min(1.0, sample / files) * 1_000_000
    train = vectors.where(drawn).select("features", F.col("labelled").cast("double").alias("label"))
    leaf = max(5, min(files, sample) // LEAVES)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=leaf, subsamplingRate=0.8, featureSubsetStrategy="0.6", seed=seed)
    model = forest.fit(train)
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1]).select(*features.columns, "score")


def machine_made(chunks: DataFrame, least: float = SCORE) -> DataFrame:
    """path, labelled, score of the files that were not written by hand here.

    They are those whose forest score is at least `least`, and those the
    labelling step itself is sure of.  Ordinary configuration has forms of its
    own, so there the score must be SURE or the file's name a generator's; a body of
    fewer than BODY characters counts only with a telling path.  Files without code chunks are none.
    """
    features = Scratch(chunks.sparkSession, "handwritten").cut(file_features(chunks))
    ordinary = (F.col("f_configuration") == 1) & (F.col("f_generated_name") == 0) & (F.col("score") < SURE)
    telling = (F.col("f_size") >= math.log1p(BODY)) | (F.col("f_foreign_folder") + F.col("f_generated_name") + F.col("f_bundled_name") > 0)
    made = F.col("labelled") | (F.col("score") >= least) & ~ordinary & telling
    return scored(features).where(made).select("path", "labelled", "score")


def found(chunks: DataFrame, least: float = SCORE) -> DataFrame:
    """file_path, as chunks spell it, of the files of `machine_made`."""
    spelled = chunks.where((F.col("source_type") == "code") & F.col("file_path").isNotNull()).select("file_path").distinct()
    made = machine_made(chunks, least).select("path")
    return spelled.withColumn("path", clean_path(F.col("file_path"))).join(made, "path", "left_semi").select("file_path")
