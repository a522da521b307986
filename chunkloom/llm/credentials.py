"""Credentials embedded in source code (problem 3).

Candidate strings are judged by their characters per subword under a public
tokenizer vocabulary: words and identifiers need few subwords, keys and random
passwords many.  Context rules then decide: the name a value is assigned to, a
provider's prefix, a place in a URL, header, connection string or command, the
fences of a private key.  Findings carry offsets, so redaction replaces the
secret alone and keeps the length and the code around it.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.tokenizer import VOCABULARIES, encoding

#: Characters per subword below which a string is unnatural, by itself and where a credential is expected.
UNNATURAL, EXPECTED = 2.6, 4.0
#: Characters per subword, and length, of a random string that is a credential under any name.
RANDOM, RANDOM_LENGTHS = 1.9, (20, 200)
VOCABULARY = "byte_bpe_50k"

#: Languages whose values stand without quotes.
_BARE = frozenset(("", "yaml", "ini", "dotenv", "toml", "markdown", "shell", "json", "env", "properties", "text", "conf"))

# --- names -------------------------------------------------------------------
#: Names of credentials, as their parts run together in lower case.
_STRONG = frozenset(
    """password passwd pwd passphrase passwort kennwort clave contrasena contraseña motdepasse mdp senha wachtwoord haslo parola
    pass dbpass userpass rootpass adminpass smtppass mailpass ftppass secret apikey apitoken apisecret secretkey masterkey
    encryptionkey signingkey privatekey accesskey accesskeysecret secretaccesskey authkey sharedkey sharedaccesskey accountkey
    accesstoken authtoken bottoken privatetoken refreshtoken bearertoken sessiontoken deploytoken personaltoken usertoken
    clientsecret webhooksecret signingsecret consumersecret appsecret sharedsecret jwtsecret storagekey servicekey
    パスワード 密码 口令""".split()
)
_STRONG_END = re.compile(r"(?:password|passwd|passphrase|passwort|kennwort|secret|apikey|secretkey|(?:session|access|auth|refresh|bearer|api|bot)token)$")
#: Names that are credentials only if the value is unnatural.
_WEAK = frozenset(("token", "auth", "authorization", "credential", "credentials", "cred", "creds", "key", "bearer", "jwt", "pw", "login"))

_ASSIGN = re.compile(r"(?P<q>[\"']?)(?P<name>[^\W\d][\w.\-]*)(?P=q)[^\S\n]*(?:\][^\S\n]*)?(?::[^\S\n]*(?:&?'?(?P<kind>\w+)[^\S\n]*)?=|:=|=>|=|:)[^\S\n]*(?P<rest>\S.*)$", re.M)
_LITERAL = re.compile(r"""[(\[{\s]*(?:[rbuRBU]{1,2}|String::from\(|@)?(?P<q>\"\"\"|'''|"|'|`)(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)?""")
_BARE_VALUE = re.compile(r"(?:[^\s,;#]|#(?=\S))\S*")

#: What stands where a credential should.
_PLACEHOLDER = re.compile(
    r"""^(?:|(.)\1*|.*\$\{.*|.*\{\{.*|.*\$\(.*|\$[A-Za-z_]\w*|.*%\(\w+\)s.*|%\w+%|.*<[^<>]*>.*|\[[^\]]*\]|\{[^}]*\}|.*\*{3,}.*|.*x{6,}.*|\.{3,}.*|.*\.{3,}|
    (?:vault|ssm|env|keyring|secretsmanager|secret|op|kms|sm|gcp|azure|sops|file|config|ref|k8s|keychain)(?::|://).*|arn:.*|ENC\[.*|
    (?:true|false|yes|no|on|off|none|null|nil|undefined|todo|fixme|tbd|n/a|empty|unset|default|redacted|removed|hidden|masked|censored|secret|password|passwd|token|string|str|value|required|optional|changeit)|
    .*(?<![a-z])(?:change[-_\s]?(?:me|this|it)|replace[-_\s]?(?:me|this|with)|your[-_\s]|[-_\s]here\b|example(?!\d)|dummy(?!\d)|placeholder|insert[-_\s]|fill[-_\s]?(?:in|me)|put[-_\s]|sample(?!\d)|not[-_\s]?(?:a[-_\s])?(?:real|set|secret)|set[-_\s]?me|redacted|fake[-_\s]).*|
    \.{0,2}/.*|[a-z]:\\.*|(?:process\.env|os\.environ|os\.getenv|env\[|std::env|system\.getenv|import\.meta).*|[\w.]+\(.*\)?\)[;,]?)$""",
    re.I | re.X,
)
_NUMBER = re.compile(r"^[-+]?[\d._]{1,5}$")
_HEX = re.compile(r"^[0-9a-fA-F]+$")

# --- context rules -------------------------------------------------------------
#: Forms of well-known tokens.
_PROVIDERS = re.compile(
    r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[\w-]{18,}|xox[abeoprs]-[A-Za-z0-9-]{16,}|xapp-[A-Za-z0-9-]{16,}|"
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{30,}|ya29\.[\w-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|dop_v1_[0-9a-f]{40,}|shpat_[0-9a-fA-F]{30,}|"
    r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|key-[0-9a-f]{32}|sq0[a-z]{3}-[\w-]{22,}|EAA[A-Za-z0-9]{40,})"
)
#: A vendor's short name and kind before a random part, in any spelling of the separators.
_VENDOR = re.compile(r"(?<![\w.\-/+])(?P<v>[a-z][a-z0-9]{1,9}[-_.][a-z][a-z0-9]{0,7}[-_.](?P<r>[A-Za-z0-9]{20,}))(?![\w/+=])")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]{1,20}://(?P<u>[^\s/:@\"'<>`]*):(?P<v>[^\s/@\"'<>`]+)@[^\s\"'<>`/@]+")
_PAIR = re.compile(r"(?i)(?<![A-Za-z])(?:SharedAccessKey|AccountKey|Password|Pwd|SharedSecret|_authToken|_auth|_password)[^\S\n]*=[^\S\n]*(?P<v>[^\s;\"'`]+)")
_HEADER = re.compile(r"(?i)(?:\b(?:proxy-)?authorization[\"']?[^\S\n]*[:=,][^\S\n]*[\"']?[^\S\n]*)?\b(?P<k>basic|bearer|token|apikey)[^\S\n]+(?P<v>[A-Za-z0-9+/_.~\-]{12,}={0,2})")
_KEY_HEADER = re.compile(r"(?i)\bx-(?:[a-z]+-)*(?:api-?key|auth-?token|token|secret|access-?key|apikey)[\"']?[^\S\n]*[:,][^\S\n]*[\"']?(?P<v>[^\s\"'`]{8,})")
_COMMANDS = (
    re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n|;]*?[^\S\n]-p(?P<v>[^\s\"'-][^\s\"']*)"),
    re.compile(r"\b(?:curl|wget|http)\b[^\n|;]*?[^\S\n](?:-u|--user)(?:=|[^\S\n])+[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)"),
    re.compile(r"(?i)(?<![\w-])--?(?:password|passwd|pass|token|api-?key|secret|secret-?key|auth-?token|access-?token)(?:=|[^\S\n]+)[\"']?(?P<v>[^\s\"'-][^\s\"']*)"),
    re.compile(r"\bsshpass[^\S\n]+-p[^\S\n]*[\"']?(?P<v>[^\s\"']+)"),
    re.compile(r"(?i)\b(?:login|user(?:name)?|machine|account)[^\S\n]+\S+[^\S\n]+(?:with[^\S\n]+)?(?:password|passwd|passwort|pass|kennwort|pw)[^\S\n]*[:=]?[^\S\n]+[\"']?(?P<v>[^\s\"']+)"),
)
#: What a text must hold, in lower case, for the rules of the same name to find anything.
_PAIR_WORDS = ("accesskey", "accountkey", "password", "pwd", "sharedsecret", "_auth")
_COMMAND_WORDS = (("mysql", "mariadb"), ("-u", "--user"), ("-pass", "-token", "-api", "-secret", "-auth", "-access"), ("sshpass",), ("pass", "kennwort", "pw"))
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINES = re.compile(r"(?:[^\S\n]*\n(?:[^\S\n]*(?:#|//|--|\*|;|[\"'`+.])*[^\S\n]*[\"'`]?(?:[A-Za-z0-9+/=]{16,}|[A-Z][\w-]+: [^\n]*)?(?:\\n)?[\"'`]?[^\S\n]*[+\\,;]?[^\S\n]*(?=\n|\Z))?)*")
_BODY = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}")
#: The rule of the further parts of a split literal.
CONTINUED = "continued"
_SECRET_KIND = re.compile(r"(?m)^[^\n\w]*kind\s*:\s*[\"']?Secret\b")
_ENTRY = re.compile(r"^[^\S\n]*[\"']?(?!kind\b)[\w.\-]+[\"']?[^\S\n]*:[^\S\n]*[\"']?(?P<v>[A-Za-z0-9+/]{8,}={0,2})[\"']?,?[^\S\n]*$", re.M)
#: Names of random strings that grant nothing.
_PUBLIC = re.compile(r"(?i)integrity|check_?sum|hash|digest|sha\d*$|md5|etag|revision|commit|fingerprint|signature|public|cert|nonce|salt|uuid|guid|(?:^|[_-])id$|icon|image|png|blob|data|sitekey|site_key")
_RANDOM = re.compile(r"[A-Za-z0-9+/_\-.~]+={0,2}$")
_CONTINUED = re.compile(r"\s*(?:#|//|--)?\s*(?:\+|\.\.|\.)?\s*(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)")
_SPLIT = re.compile(r"(?P<q>[\"'`])\s*(?:(?:\+|\\|\.\.|\.|&|,)\s*){0,2}$")


@lru_cache(maxsize=100_000)
def characters_per_subword(text: str, folder: str = VOCABULARIES) -> float:
    """Characters of a string per subword of the vocabulary; small for random strings."""
    return len(text) / max(1, len(encoding(VOCABULARY, folder).encode_ordinary(text)))


def unnatural(text: str, least: int = 8, below: float = UNNATURAL) -> bool:
    """Whether a string of at least `least` characters has few characters per subword."""
    return len(text) >= least and characters_per_subword(text) < below


def random_string(text: str) -> bool:
    """Whether a string can be nothing but random: letters of both cases and digits, and hardly more than one character a subword."""
    lo, hi = RANDOM_LENGTHS
    mixed = lo <= len(text) <= hi and _RANDOM.match(text) and re.search("[A-Z]", text) and re.search("[a-z]", text) and re.search(r"\d", text)
    return bool(mixed) and not re.match(r"sha\d{1,3}-", text) and characters_per_subword(text) < RANDOM


def placeholder(value: str) -> bool:
    """Whether a value is empty, a reference, a path, a number of few digits or an invitation to fill in one."""
    value = value.strip()
    if value.startswith("/") and re.search(r"\d", value) and re.search("[A-Z]", value) and re.search("[a-z]", value) and unnatural(value, 16):
        return False  # base64 that happens to begin like a path
    return bool(_PLACEHOLDER.match(value) or _NUMBER.match(value))


@lru_cache(maxsize=100_000)
def strength(name: str) -> int:
    """2 for a credential's name, 1 for one that may be, 0 for others."""
    flat = re.sub(r"[_.\-]", "", name).lower()
    last = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.split(".")[-1]).lower().replace("-", "_")
    whole = last.replace("_", "")
    if flat in _STRONG or whole in _STRONG or _STRONG_END.search(whole) and not whole.endswith(("nosecret", "publicapikey")):
        return 2
    return 1 if last in _WEAK else 0


def _continued(text: str, at: int) -> Iterator[tuple[int, int]]:
    """Spans of the parts of a split literal in the lines that follow the line break at `at`."""
    while at >= 0:
        end = text.find("\n", at + 1)
        m = _CONTINUED.match(text, at + 1, end if end >= 0 else len(text))
        if not m:
            return
        yield m.span("v")
        if not re.search(r"(?:\+|\\|\.\.)\s*$", text[m.end() : end if end >= 0 else len(text)]):
            return
        at = end


def _decoded(value: str) -> str | None:
    """Printable text that a base64 value holds."""
    try:
        raw = base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
        text = raw.decode("utf-8")
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return None
    return text.strip() if text.strip() and text.strip().isprintable() else None


def _assigned(text: str, language: str, secret_kind: bool, at: int = 0, to: int | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, rule) of values assigned to names of credentials, and of random strings under any name."""
    for m in _ASSIGN.finditer(text, at, len(text) if to is None else to):
        name, rest, base = m["name"], m["rest"].rstrip("\r"), m.start("rest")
        power = strength(name) or (strength(m["kind"]) if m["kind"] else 0)  # `was: password = ...` looks like a type
        if not power:
            lit = _LITERAL.match(rest)
            bare = None if lit else _BARE_VALUE.match(rest)
            value = lit["v"] if lit else bare[0].rstrip(",;") if bare else ""
            if not _PUBLIC.search(name) and random_string(value) and not placeholder(value):
                start = base + (lit.start("v") if lit else bare.start())
                yield start, start + len(value), "random"
            inner = _inner(rest)
            if inner is not None:
                yield from _assigned(text, language, secret_kind, base + inner, base + len(rest))
            continue
        begin = text.rfind("\n", 0, m.start()) + 1
        lit = _LITERAL.match(rest)
        comment = text[begin : begin + 200].lstrip().startswith(("#", "//", "--", ";", "*", "/*"))
        parts: list[tuple[int, int]] = []
        if lit:
            value, start = lit["v"], base + lit.start("v")
            after = rest[lit.end() :]
            if re.match(r"\s*(?:\.format|%\s|\]|\()", after):
                continue
            if _SPLIT.search(rest[lit.start() :]) and re.search(r"(?:\+|\\|\.\.|[\"'`])\s*$", rest) and (rest.lstrip().startswith("(") or re.search(r"(?:\+|\\|\.\.)\s*$", rest)):
                parts = list(_continued(text, text.find("\n", base)))
                value += "".join(text[a:b] for a, b in parts)
        elif language in _BARE or comment:
            bare = _BARE_VALUE.match(rest)
            if not bare:
                continue
            value = bare[0].rstrip(",;")
            start = base + bare.start()
            if re.search(r"\s(?:[-+*/|&?<>=]|==)\s|=>|\(\)", rest) and not unnatural(value):
                continue
        else:
            continue
        end = start + len(lit["v"] if lit else value)
        if "PRIVATE KEY-----" in value or placeholder(value) or len(value) < 4:
            continue
        if value.split(":")[0].lower() in ("authorization",) or re.match(r"(?i)(?:basic|bearer)\s", value):
            continue  # left to the header rule
        if re.match(r"[a-z][a-z0-9+.-]*://", value):
            continue  # left to the URL rule
        if power == 1 and not (re.search(r"\d", value) and re.search(r"[^\W\d_]", value) and not re.search(r"\s", value) and (unnatural(value) if name.lower().endswith("token") else unnatural(value, 12))):
            continue
        if power == 2 and (not re.search(r"[^\W_]", value) or name.lower().endswith("token") and value.isalpha() and len({c.isupper() for c in value}) == 1):
            continue  # a machine's token has digits or letters of both cases
        if power == 2 and not (unnatural(re.sub(r"\s+", "", value)) if re.search(r"\s", value) else expected(value)):
            continue  # a sentence, or words
        if secret_kind and (said := _decoded(value)) is not None and placeholder(said):
            continue
        yield start, end, "name"
        yield from ((a, b, CONTINUED) for a, b in parts)


def expected(value: str) -> bool:
    """Whether a string may be a credential where one is expected: no words of a language."""
    return unnatural(value, 4, EXPECTED)


def _inner(rest: str) -> int | None:
    """Where another assignment may begin in the value of one."""
    m = re.search(r"(?:^|[{,;&?\s(*])(?=[\"']?[^\W\d][\w.\-]*[\"']?\s*(?::=|=>|=|:)\s*\S)", rest)
    return m.end() if m else None


def _patterns(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, rule) of values that their form or place in a line gives away."""
    for m in _PROVIDERS.finditer(text):
        if unnatural(m["v"], 16, EXPECTED):
            yield *m.span("v"), "provider"
    for m in _VENDOR.finditer(text):
        r = m["r"]
        if unnatural(r, 16) and re.search(r"\d", r) and re.search(r"[a-z]", r) and re.search(r"[A-Z]", r):
            yield *m.span("v"), "vendor"
    low = text.lower()
    if "://" in text and "@" in text:
        for m in _URL.finditer(text):
            if not placeholder(m["v"]) and expected(m["v"]):
                yield *m.span("v"), "url"
    if "=" in text and any(w in low for w in _PAIR_WORDS):
        for m in _PAIR.finditer(text):
            own = strength(m[0].split("=")[0].strip()) != 2 or m[0].lower().startswith(("sharedaccesskey", "accountkey", "_auth"))
            if own and not placeholder(m["v"]) and expected(m["v"]):
                yield *m.span("v"), "pair"
    for m in _HEADER.finditer(text):
        v = m["v"]
        if placeholder(v):
            continue
        if m["k"].lower() == "basic":
            said = _decoded(v)
            if said and ":" in said and not placeholder(said.split(":", 1)[1]) and unnatural(v):
                yield *m.span("v"), "header"
        elif unnatural(v, 16) and re.search(r"\d", v):
            yield *m.span("v"), "header"
    if "x-" in low:
        for m in _KEY_HEADER.finditer(text):
            if not placeholder(m["v"]) and unnatural(m["v"]):
                yield *m.span("v"), "header"
    for command, needs in zip(_COMMANDS, _COMMAND_WORDS):
        for m in command.finditer(text) if any(w in low for w in needs) else ():
            if not placeholder(m["v"]) and expected(m["v"]):
                yield *m.span("v"), "command"


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of private keys that have a body; without an end line up to the last line that looks like one."""
    for m in _PEM.finditer(text):
        close = re.compile(r"-----END[^\n]*?-----").search(text, m.end())
        begins = _PEM.search(text, m.end())
        if close and (not begins or close.start() < begins.start()):
            end, last = close.start(), close.end()
        else:
            end = last = m.end() + _KEY_LINES.match(text, m.end()).end() - m.end()
        if any(unnatural(b, 20) for b in _BODY.findall(text[m.end() : end].replace("\\n", "\n"))):
            yield m.start(), last


def _encoded(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, rule) of the entries of a manifest of secrets, whose values are base64."""
    for m in _ENTRY.finditer(text):
        said = _decoded(m["v"]) if len(m["v"]) % 4 == 0 else None
        if said and len(said) >= 4 and not placeholder(said) and re.search(r"[^A-Za-z\s]", said) and unnatural(m["v"]):
            yield *m.span("v"), "encoded"


def find(text: str | None, language: str | None = "") -> list[tuple[int, int, str]]:
    """(start, end, rule) of each credential in a text, by offset; overlapping finds are one.

    The further parts of a literal that is split over lines have the rule CONTINUED.
    """
    if not text:
        return []
    language = (language or "").strip().lower()
    secret_kind = bool(_SECRET_KIND.search(text))
    found = [(a, b, "private key") for a, b in _private_keys(text)] if "PRIVATE KEY" in text else []
    fenced = list(found)
    for a, b, rule in (*_patterns(text), *_assigned(text, language, secret_kind), *(_encoded(text) if secret_kind else ())):
        if not any(x <= a and b <= y for x, y, _ in fenced):
            found.append((a, b, rule))
    found.sort(key=lambda x: (x[0], x[2] == CONTINUED, x[1]))
    out: list[tuple[int, int, str]] = []
    for a, b, rule in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        else:
            out.append((a, b, rule))
    return out


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "*") -> str | None:
    """The text with each span's characters, line breaks aside, replaced; offsets of all else stay."""
    if not text:
        return text
    for a, b, _ in spans:
        text = text[:a] + re.sub(r"[^\r\n]", mark, text[a:b]) + text[b:]
    return text


def findings(chunks: DataFrame) -> DataFrame:
    """chunk_id, line_no, start, end, rule of each credential in content_raw.

    line_no is the 1-based line on which it begins; the further parts of a split
    literal come with the rule CONTINUED.  All rows are looked at, deleted ones
    included; repeated rows of a chunk give one row.  Null and empty texts have
    none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, language, text in zip(pdf.id.tolist(), pdf.language.tolist(), pdf.content_raw.tolist()):
                for a, b, rule in find(text, language):
                    rows.append((i, text.count("\n", 0, a) + 1, a, b, rule))
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "start", "end", "rule"])

    some = chunks.where(F.col("id").isNotNull() & F.col("content_raw").isNotNull()).select("id", "language", "content_raw")
    return some.mapInPandas(run, "chunk_id long, line_no long, start long, end long, rule string").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """The chunks with credentials in content_raw masked; every other column and character stays."""

    @F.pandas_udf("string")
    def mask(text: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([redact(t, find(t, x)) if t else t for t, x in zip(text.tolist(), language.tolist())], dtype=object)

    return chunks.withColumn("content_raw", mask("content_raw", "language"))
