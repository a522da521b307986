"""Text cut off by field limits or a broken transfer (problem 10).

A backward character n-gram model is counted over all texts.  It is a tree over
contexts read from the last character back: each node knows how often its
context came before a boundary (the end of a text, a line or a sentence, or a mark
put in place of the rest) and how often the text went on.  The log-odds of end
against continuation for a text's final context tell whether anything normally
ends like that.

Only the nodes on the way to the end of some text are ever asked for.  So a first
reading takes the ends and counts words; a bitmap of the ends' contexts goes to
all tasks, which count in a second reading every place whose context it has.
The counts are added up by context and joined to the ends; the tree itself is
nowhere in one place.  What a text's own end added is taken off again, so that a
text is judged by the others.

What the whole text says about its end enters as a further log-odds term: whether
a code block or bracket is left open, or whether a fence, a table row or a
sentence has just been closed.  How much that weighs is learned from all texts
too, by comparing their ends with the same texts cut at random.

A text is cut if its log-odds lie below a threshold of its language and column:
all values of the column are judged first, and each language's threshold is put
where fewest of its values lie.

Contexts are kept apart by the kind of line they stand in.  Rare words, mostly
names, are folded to one character each, digits to 0.  A context that never came
before a boundary, seen often enough, isn't extended: nothing longer can say
more.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.common import Scratch

#: Characters that a task counts at a time, and rows of counts that it holds before it adds them up.
CHUNK, HELD = 500_000, 3_000_000
#: Share of all words from which a word counts as known.
WORD_SHARE = 4e-5
#: Longest context, least count of a node, count from which a context without a boundary is final.
ORDER, LEAST, PURE = 24, 8, 40
#: Weight of the shorter context in a node's estimate, in counts.
STRENGTH = 3.0
#: Log-odds around which the threshold of a language is looked for, by kind of line, where the last word is no known word, and where it is one.
THRESHOLD = {"prose": -0.5, "list": -1.0, "table": -1.0, "sign": -1.0, "code": -1.0, "heading": -3.0, "link": -3.0}
THRESHOLD_KNOWN = THRESHOLD | {"list": -6.0, "code": -6.0, "heading": -6.0}
#: A language's threshold lies at most so far from that, in bins of BIN; fewer values than FEW do not move it.
REACH, BIN, FEW = 1.0, 0.25, 50
#: Least share of whole texts that is assumed to end in a state that none was seen to end in.
RARE = 1e-5

STATES = ("plain", "open", "closed")
KINDS = ("prose", "list", "table", "sign", "code", "heading", "link")
#: Kinds in which a text that ends in an unknown word may be cut itself.
_DOUBTFUL = np.array([k in ("prose", "list", "code") for k in KINDS])
#: Characters at the end that hold the longest context, words and all.
TAIL = 400
_END = "\x00"
_RARE, _NAME = "", ""
#: Marks in place of the rest.
_MARK = re.compile(r"\s*(?:\.{3,}|…|\[\.{3}\]|\[…\]|\(\.{3}\)|\(…\)|[\[(<](?:truncated|cut|snip|gekürzt|tronqué|truncado|continued|more)[\])>]|�+|>>>)\s*$", re.I)
_MARK_ENDS = ("...", "…", "]", ")", ">", "\ufffd")
#: Read from the end of a text.
_LAST_WORD = re.compile(r"\W*([A-Za-zÀ-ÖØ-öø-ÿ]+(?:['’][A-Za-zÀ-ÖØ-öø-ÿ]+)*)")
_TERMINAL = re.compile(r"\s*[\"'”’»)）」』\]*_`]*[.!?。！？؟]")
_CLOSING = re.compile(r"[})\]]|end\b")
_FENCE_LINE = re.compile(r"^[ \t]{0,12}```", re.M)
_FENCE = re.compile(r"^\s*```", re.M)
_DIGITS = str.maketrans("123456789", "000000000")
#: Of each character: 1 for a small letter, 2 for a capital one, 3 for an apostrophe.
_LETTER = np.zeros(0x3000, np.uint8)
_LETTER[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_LETTER[[*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] = 2
_LETTER[[0x27, 0x2019]] = 3
#: Of each character: 1 if it ends a sentence, 2 if it may follow one that does.
_TERM = np.zeros(0x10000, np.uint8)
_TERM[[ord(c) for c in ".!?。！？"]] = 1
_TERM[[ord(c) for c in "\"'”’»)）」』]*`"]] = 2
#: What a line or sentence begins after.
_OPENERS = (0, 10, 33, 46, 63)
#: Numbers of the hashes: of words (letters by their last ten bits) and of contexts.
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.random.default_rng(5).integers(1, 2**63, 0x400).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ROOTS = np.random.default_rng(6).integers(1, 2**63, len(KINDS)).astype(np.uint64)


def plain(text: str) -> str:
    """The text with unified line ends and digits, and without white space at its end."""
    text = text.replace("\r\n", "\n").rstrip()
    return text.translate(_DIGITS) if text.isascii() else re.sub(r"\d", "0", text)


def characters(texts: list[str]) -> np.ndarray:
    """The code points of the texts, each followed by a 0, after as many zeros as the longest context has characters."""
    joined = "".join([_END * ORDER, *(t.replace(_END, " ") + _END for t in texts)])
    return np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)


class Piece(NamedTuple):
    """A text, or a part of a long one with what comes `before` and `after` it, in characters, that is not counted."""

    text: str
    code: bool
    before: int = 0
    after: int = 0


def pieces(text: str, code: bool) -> Iterator[Piece]:
    """A plain text in parts of at most CHUNK characters, cut at white space.

    A part follows the TAIL characters before it, the start of its line and a
    fence if the block is open, so that its contexts and kinds of line are those
    of the whole text.
    """
    begin, line, odd = 0, 0, 0
    while len(text) - begin > CHUNK:
        stop = max(text.rfind(c, begin + CHUNK // 2, begin + CHUNK) for c in "\n ") + 1 or begin + CHUNK
        yield _part(text, code, begin, stop, line, odd)
        start = max(line, text.rfind("\n", line, stop) + 1)
        odd = (odd + len(_FENCE_LINE.findall(text[line:start]))) % 2
        begin, line = stop, start
    yield _part(text, code, begin, len(text), line, odd)


def _part(text: str, code: bool, begin: int, stop: int, line: int, odd: int) -> Piece:
    """The part from begin to stop; line: where its first line begins, odd: whether a block is open there."""
    if begin == 0:
        head = ""
    elif begin - line > TAIL:
        head = "```\n" * odd + text[line : line + 20] + " " + text[begin - TAIL : begin]
    else:
        near = text[max(0, line - TAIL) : line]
        own = near[near.find("\n") + 1 :] if line > TAIL else near
        block = (odd + len(_FENCE_LINE.findall(own))) % 2
        cut = near[: len(near) - len(own)]
        head = "```\n" * block + (cut and "x " + cut) + own + text[line:begin]
    tail = text[stop : stop + 40]
    return Piece(head + text[begin:stop] + tail, code, len(head), len(tail))


def chunks(texts: list[str], code: list[bool]) -> Iterator[list[Piece]]:
    """The texts, long ones in pieces, in groups of about CHUNK characters."""
    some: list[Piece] = []
    size = 0
    for piece in (x for t, c in zip(texts, code) for x in pieces(t, c)):
        if some and size + len(piece.text) > CHUNK:
            yield some
            some, size = [], 0
        some.append(piece)
        size += len(piece.text)
    if some:
        yield some


def spread(some: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of pieces, and which of them are counted."""
    a = characters([x.text for x in some])
    own = np.ones(len(a), bool)
    at = ORDER
    for x in some:
        if x.before or x.after:
            own[at : at + x.before] = False
            own[at + len(x.text) - x.after : at + len(x.text)] = False
        at += len(x.text) + 1
    return a, own


def words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word: letters, with single apostrophes between them."""
    kind = _LETTER[np.minimum(a, 0x2FFF)]
    apostrophe = np.flatnonzero(kind == 3)
    if len(apostrophe):
        inner = apostrophe[(kind[apostrophe - 1] & 3) % 3 > 0]
        inner = inner[(kind[np.minimum(inner + 1, len(a) - 1)] & 3) % 3 > 0]
        kind = np.where(kind == 3, 0, kind).astype(np.uint8)
        kind[inner] = 3
    inside = (kind > 0).view(np.int8)
    turn = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    start, end = turn[::2], turn[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    size = end - start
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    power = np.cumprod(np.full(int(size.max()), _PRIME, np.uint64))
    hashes = np.add.reduceat(_SPREAD[a[inside.view(bool)] & 0x3FF] * power[place], before)
    return start, end, hashes


def word_hashes(said: list[str]) -> np.ndarray:
    """The hash of each of the words."""
    return words(characters(said))[2]


def word_counts(some: list[Piece]) -> pd.DataFrame:
    """word (hash), count, first (times it begins a line or sentence), free (known whatever it begins) of the words of texts."""
    a, own = spread(some)
    start, end, hashes = words(a)
    start, end, hashes = (x[own[start]] for x in (start, end, hashes))
    c1, c2, c3 = (a[start - k] for k in (1, 2, 3))
    before = np.where(c1 != 32, c1, np.where(c2 != 32, c2, np.where(c3 != 32, c3, 0)))
    codes, word = pd.factorize(hashes)
    count = np.bincount(codes, minlength=len(word))
    first = np.bincount(codes, weights=np.isin(before, _OPENERS), minlength=len(word)).astype(np.int64)
    at = np.zeros(len(word), np.int64)
    at[codes] = np.arange(len(codes))
    kind = _LETTER[np.minimum(a, 0x2FFF)]
    lower = np.r_[0, np.cumsum(kind == 1)]
    s, e = start[at], end[at]
    free = (kind[s] == 1) | (lower[e] == lower[s]) & (e - s > 1)
    return pd.DataFrame({"word": word.view(np.int64), "count": count, "first": first, "free": free})


def fold(a: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters with each unknown word as one, and which places stay; known: the sorted hashes of the known words."""
    start, end, hashes = words(a)
    there = np.searchsorted(known, hashes)
    strange = (end - start > 1) & (known[np.minimum(there, len(known) - 1)] != hashes if len(known) else True)
    start, end = start[strange], end[strange]
    out = a.copy()
    out[start] = np.where(_LETTER[a[start]] == 2, ord(_NAME), ord(_RARE))
    gone = np.zeros(len(a) + 1, np.int8)
    gone[start + 1] += 1
    gone[end] -= 1
    stay = np.cumsum(gone[:-1], dtype=np.int8) == 0
    return out[stay], stay


def line_kinds(a: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The number of the kind of line at each place of texts that end in 0; code: a flag for each text."""
    n = len(a)
    starts = np.r_[0, np.flatnonzero((a == 10) | (a == 0))[:-1] + 1]
    f = starts.copy()
    for _ in range(12):
        f += (f < n - 1) & np.isin(a[f], (9, 32))
    c0, c1, c2 = (a[np.minimum(f + k, n - 1)] for k in range(3))
    kind = np.zeros(len(starts), np.uint8)
    kind[np.isin(c0, (ord("-"), ord("*"))) & (c1 == 32)] = 1
    kind[c0 == ord("|")] = 2
    kind[(c0 == ord("-")) & (c1 == ord("-")) & (c2 == 32)] = 3
    kind[c0 == ord("#")] = 5
    text = np.searchsorted(np.flatnonzero(a == 0), starts)
    fence = (c0 == 96) & (c1 == 96) & (c2 == 96)
    k = np.cumsum(fence)
    opening = np.r_[True, text[1:] != text[:-1]]
    before = np.maximum.accumulate(np.where(opening, k - fence, 0))
    kind[((k - before) % 2 == 1) | fence | code[text]] = 4
    out = np.repeat(kind, np.diff(starts, append=n))
    # a link runs from its "://" to the next white space
    slash = np.flatnonzero(a == 47)
    slash = slash[slash >= 2]
    slash = slash[(a[slash - 1] == 47) & (a[slash - 2] == 58)]
    if len(slash):
        white = np.flatnonzero(np.isin(a, (0, 9, 10, 32)))
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, slash, 1)
        np.add.at(step, white[np.searchsorted(white, slash)], -1)
        out[(np.cumsum(step[:-1]) > 0) & (out != 4)] = 6
    return out


def fences(text: str) -> int:
    """How many lines of a text begin or end a code block."""
    return len(_FENCE.findall(text)) if "```" in text else 0


def kind_of(text: str, code: bool) -> str:
    """The kind of a text's last line."""
    if code or fences(text) % 2 or text.endswith("```"):
        return "code"
    line = text[text.rfind("\n") + 1 :]
    if "://" in re.split(r"\s", line)[-1]:
        return "link"
    line = line.lstrip()
    if line[:3] == "-- ":
        return "sign"
    return "list" if line[:2] in ("- ", "* ") else "table" if line[:1] == "|" else "heading" if line[:1] == "#" else "prose"


def mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of a context with one more character."""
    return (h ^ c) * _PRIME


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each hash in a bitmap of 2**bits bits."""
    return h >> np.uint64(64 - bits)


def context_counts(some: list[Piece], known: np.ndarray, wanted: np.ndarray | None = None) -> pd.DataFrame:
    """context (hash), depth, ended, seen of the contexts of plain texts; of wanted ones alone if there is a bitmap of them.

    A place is followed back as far as its context is wanted, and counts for that
    context and all shorter ones.  A bit that is set by chance adds a context
    that nobody asks for.
    """
    a, own = spread(some)
    a, stay = fold(a, known)
    kinds = line_kinds(a[ORDER:], np.array([*(x.code for x in some), False]))
    kinds = np.r_[np.zeros(ORDER, np.uint8), kinds]
    following = np.r_[a[1:], np.uint32(0)]
    dot = a == ord(".")
    mark = (a == 0x2026) | (a == 0xFFFD)
    mark[:-2] |= dot[:-2] & dot[1:-1] & dot[2:]
    term = _TERM[np.minimum(a, 0xFFFF)]
    sentence = (term == 1) | (term == 2) & np.r_[False, term[:-1] == 1]
    sentence &= (following == 32) | (term == 1) & (a > 0x2000)
    marked = np.r_[mark[1:], False]
    boundary = (following == 0) | (following == 10) | marked | sentence
    # texts that end in an unknown word may be cut themselves; their ends teach nothing
    doubtful = (a == ord(_RARE)) & ((following == 0) | marked) & _DOUBTFUL[kinds]
    at = np.flatnonzero((a != 0) & (a != 10) & ~mark & ~doubtful & own[stay]).astype(np.int32)
    h = _ROOTS[kinds[at]]
    bits = 0 if wanted is None else (len(wanted) * 8 - 1).bit_length()
    left: list[tuple[np.ndarray, np.ndarray]] = []
    for back in range(ORDER):
        char = a[at - np.int32(back)]
        longer = mixed(h, char)
        on = char != 0
        if wanted is not None:
            byte = wanted[places(longer, bits - 3).view(np.int64)]
            on &= (byte >> (places(longer, bits).astype(np.uint8) & np.uint8(7)) & np.uint8(1)).view(bool)
        on, off = np.flatnonzero(on), np.flatnonzero(~on)
        left.append((h[off], at[off]))
        at, h = at[on], longer[on]
        if not len(at):
            break
    if len(at):
        left.append((h, at))
    depth = np.repeat(np.arange(len(left), dtype=np.int8), [len(x) for x, _ in left])
    h, at = (np.concatenate(x) for x in zip(*left))
    codes, contexts = pd.factorize(h)
    seen = np.bincount(codes, minlength=len(contexts))
    ended = np.bincount(codes, weights=boundary[at], minlength=len(contexts)).astype(np.int64)
    one = np.zeros(len(contexts), np.int64)
    one[codes] = np.arange(len(codes))
    at, depth = at[one], depth[one]
    # each context hands its counts on to the one that is shorter by a character
    h = [_ROOTS[kinds[at]]]
    for back in range(int(depth.max(initial=0))):
        h.append(mixed(h[-1], a[np.maximum(at - back, 0)]))
    parts = []
    row, e, n = (np.zeros(0, np.int64) for _ in range(3))
    for d in range(len(h) - 1, -1, -1):
        here = np.flatnonzero(depth == d)
        row, e, n = (np.concatenate(x) for x in ((row, here), (e, ended[here]), (n, seen[here])))
        codes, contexts = pd.factorize(h[d][row])
        e, n = (np.bincount(codes, weights=x, minlength=len(contexts)).astype(np.int64) for x in (e, n))
        one = np.zeros(len(contexts), np.int64)
        one[codes] = row
        row = one
        parts.append(pd.DataFrame({"context": contexts, "depth": np.int8(d), "ended": e, "seen": n}))
    return pd.concat(parts, ignore_index=True)


def added(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The counts of several tables of contexts, added up."""
    each = pd.concat(parts)
    codes, contexts = pd.factorize(each.context.to_numpy())
    depth = np.zeros(len(contexts), np.int8)
    depth[codes] = each.depth.to_numpy()
    ended, seen = (np.bincount(codes, weights=each[c].to_numpy(), minlength=len(contexts)).astype(np.int64) for c in ("ended", "seen"))
    return pd.DataFrame({"context": contexts, "depth": depth, "ended": ended, "seen": seen})


def paths(tails: list[str], kinds: list[int], known: np.ndarray) -> list[np.ndarray]:
    """The hashes of the contexts of the ends of texts, from the kind of line to the longest one."""
    if not tails:
        return []
    a = fold(characters(tails), known)[0]
    h = _ROOTS[np.array(kinds)]
    at = np.flatnonzero(a == 0)[ORDER:] - 1
    out, depth = [h], np.zeros(len(h), np.int64)
    on = np.ones(len(h), bool)
    for back in range(ORDER):
        char = a[np.maximum(at - back, 0)]
        on &= char != 0
        h = mixed(h, char)
        out.append(h)
        depth += on
    return [row[: d + 1] for row, d in zip(np.stack(out, 1), depth)]


def train(texts: list[str], code: list[bool]) -> dict:
    """The model of a few texts, in this process: hashes of known words, counts of contexts, weights of states."""
    texts = [plain(t) for t in texts]
    some = [Piece(t, c) for t, c in zip(texts, code)]
    count = word_counts(some)
    known = known_words(count, int(count["count"].sum()))
    each = context_counts(some, known)
    ends, cuts = (Counter(state(t, c) for t, c in zip(x, code)) for x in (texts, [cut_anywhere(t) for t in texts]))
    return {"known": known, "counts": dict(zip(each.context.tolist(), zip(each.ended.tolist(), each.seen.tolist()))), "states": state_weights(ends, cuts)}


def known_words(count: pd.DataFrame, total: int) -> np.ndarray:
    """Hashes of the words that are frequent; of capitalised ones those that mostly begin a line or sentence, so no names."""
    kept = count[(count["count"] >= max(5, WORD_SHARE * total)) & (count.free | (count["first"] >= 0.7 * count["count"]))]
    return np.sort(kept.word.to_numpy(np.int64).view(np.uint64))


def cut_anywhere(text: str) -> str:
    """The text cut at a place that its own checksum draws."""
    return text[: 1 + zlib.crc32(text.encode("utf-8", "replace")) % max(1, len(text))].rstrip()


def state_weights(ends: Counter[str], cuts: Counter[str]) -> dict[str, float]:
    """Log-odds of an end against a cut in each state, relative to `plain`, by the states of texts and of the same texts cut anywhere.

    The ends hold some cut texts themselves: as many as the state can explain that
    is rarest among ends for its share among cuts, and those are taken out.
    """
    n = max(1, sum(ends.values()))
    end, cut = ({s: (k[s] + 0.5) / (n + 1.5) for s in STATES} for k in (ends, cuts))
    mixed_in = min(0.5, *(end[s] / cut[s] for s in STATES))
    weight = {s: math.log(max(RARE, (end[s] - mixed_in * cut[s]) / (1 - mixed_in)) / cut[s]) for s in STATES}
    return {s: weight[s] - weight["plain"] for s in STATES}


def log_odds(counts: Iterable[tuple[int, int]], own: tuple[int, int] = (0, 0)) -> float:
    """Log-odds of an end against a continuation by the counts (ended, seen) of a text's last contexts, shortest first.

    own: what the text's own end added to each of them; only others tell.
    """
    own_ended, own_seen = own
    p = None
    for ended, seen in counts:
        ended = ended - own_ended if ended > own_ended else 0
        seen = seen - own_seen if seen > own_seen else 0
        if p is None:
            p = (ended + 0.05) / (seen + 0.1)
            continue
        if seen < LEAST:
            break
        p = (ended + STRENGTH * p) / (seen + STRENGTH)
        if ended == 0 and seen >= PURE:
            break
    p = 0.5 if p is None else min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def _open_brackets(text: str) -> int:
    """Brackets that stay open at the end of code, strings and comments aside."""
    text = re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`|//[^\n]*|#[^\n]*|--[^\n]*", "", text)
    depth = 0
    for c in re.findall(r"[{}]", text):
        depth = max(0, depth + (1 if c == "{" else -1))
    return depth


def state(body: str, code: bool, marked: bool = False) -> str:
    """`open` if a code block or bracket is, `closed` if a fence, table row or sentence has just been, else `plain`."""
    last_line = body[body.rfind("\n") + 1 :]
    if fences(body) % 2 if not code else _open_brackets(body) and not _CLOSING.match(last_line):
        return "open"
    kind = kind_of(body, code)
    if not marked and (body.endswith("```") or kind == "table" and body.endswith("|") or (kind != "code" or not re.search(r"[(){}=;]", last_line)) and _TERMINAL.match(body[: -TAIL - 1 : -1])):
        return "closed"
    return "plain"


class End(NamedTuple):
    """Of a plain text without the mark at its end: kind, state, tail, last word, and whether what follows is the end or a mark."""

    kind: str
    state: str
    tail: str
    last: str
    final: bool


def described(text: str, code: bool) -> End:
    """How a plain text ends."""
    mark = _MARK.search(text) if text.endswith(_MARK_ENDS) else None
    body = text[: mark.start()] if mark and mark.start() else text
    tail = body[-TAIL:]
    last = _LAST_WORD.match(tail[::-1])
    final = len(body) == len(text) or text.startswith(("...", "…", "\ufffd"), len(body))
    return End(kind_of(body, code), state(body, code, bool(mark)), tail, last[1][::-1] if last else "", final)


def own_counts(kind: str, tail: str, last: str, final: bool, known: bool) -> tuple[int, int]:
    """What a text's own end added to the counts (ended, seen) of its contexts."""
    if not final:
        return 0, 1
    strange = not known and len(last) > 1 and last[0].islower() and tail.endswith(last)
    return (0, 0) if strange and _DOUBTFUL[KINDS.index(kind)] else (1, 1)


def shortened(tail: str) -> str:
    """As much of a tail as its longest context can need: words and what separates them count at least one each."""
    near = tail[-160:]
    return near.split(None, 1)[1] if len(near.split()) > ORDER // 2 + 2 else tail


def are_known(last: list[str], known: np.ndarray) -> np.ndarray:
    """Whether each word is known; no word counts as known."""
    there = np.array([w != "" for w in last], bool)
    out = ~there
    out[there] = np.isin(word_hashes([w for w in last if w]), known)
    return out


def threshold(kind: str, known: bool) -> float:
    return (THRESHOLD_KNOWN if known else THRESHOLD)[kind]


def judge(model: dict, text: str | None, code: bool, trained: bool = False) -> tuple[float, float] | None:
    """The log-odds of a text's end, and how far they lie above the middle threshold; None for null, empty and blank texts.

    trained: whether the model has counted the text itself.
    """
    if not text or not text.strip():
        return None
    end = described(plain(text), code)
    known = bool(are_known([end.last], model["known"])[0])
    own = own_counts(end.kind, end.tail, end.last, end.final, known) if trained else (0, 0)
    path = paths([shortened(end.tail)], [KINDS.index(end.kind)], model["known"])[0].tolist()
    odds = log_odds((model["counts"].get(h, (0, 0)) for h in path), own) + model["states"][end.state]
    return odds, odds - threshold(end.kind, known)


def valley(counts: dict[int, int]) -> float:
    """Where between -REACH and REACH fewest values lie (counts of bins of width BIN), nearest to 0."""
    edges = range(-round(REACH / BIN), round(REACH / BIN) + 1)
    near = {e: sum(counts.get(e + k, 0) for k in (-2, -1, 0, 1)) for e in edges}
    return min(edges, key=lambda e: (near[e], abs(e), e)) * BIN


#: The model of no texts.
EMPTY = {"known": np.zeros(0, np.uint64), "counts": {}, "states": dict.fromkeys(STATES, 0.0)}


#: What a row of the first reading tells of: a document (free: the end or a mark follows), a word, the states of ends and of cuts, or the number of words.
DOCUMENT, WORD, END, CUT, TOTAL = range(5)


def _first_reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document, and the counts of words and states."""
    held: list[pd.DataFrame] = []
    rows = 0
    states: Counter[tuple[int, str]] = Counter()

    def summed() -> pd.DataFrame:
        return pd.concat(held).groupby("word", as_index=False, sort=False).agg({"count": "sum", "first": "sum", "free": "max"})

    def word_rows(each: pd.DataFrame) -> pd.DataFrame:
        return each.assign(what=WORD, doc_id=None, source=None, language=None, kind=-1, state=None, tail=None, last=None)

    for pdf in batches:
        code = (pdf.source_type == "code").tolist()
        texts = [plain(t) if t and t.strip() else "" for t in pdf.text.tolist()]
        seen = [described(t, c) if t else None for t, c in zip(texts, code)]
        for t, c, d in zip(texts, code, seen):
            if t:
                states[END, state(t, c) if t.endswith(_MARK_ENDS) else d.state] += 1
                states[CUT, state(cut_anywhere(t), c)] += 1
        for some in chunks(texts, code):
            held.append(word_counts(some))
            states[TOTAL, ""] += int(held[-1]["count"].sum())
            rows += len(held[-1])
            if rows > HELD:
                held = [summed()]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield word_rows(held[0])
                    held, rows = [], 0
        out = pd.DataFrame({"what": DOCUMENT, "doc_id": pdf.doc_id, "source": pdf.source, "language": pdf.language, "kind": [KINDS.index(d.kind) if d else -1 for d in seen], "state": [d and d.state for d in seen], "tail": [d and shortened(d.tail) for d in seen], "last": [d and d.last for d in seen], "word": 0, "count": 0, "first": 0, "free": [bool(d and d.final) for d in seen]})
        yield out[pdf.named.to_numpy(bool)]
    if held:
        yield word_rows(summed())
    if states:
        yield pd.DataFrame({"what": [w for w, _ in states], "doc_id": None, "source": None, "language": None, "kind": -1, "state": [s for _, s in states], "tail": None, "last": None, "word": 0, "count": list(states.values()), "first": 0, "free": False})


def bitmap(each: DataFrame, documents: int) -> np.ndarray:
    """A bitmap in which the bit of each context on the paths is set; it has 16 bits for each document, 64 MB at most."""
    bits = min(29, max(16, (16 * documents).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            place = np.unique(places(np.concatenate(pdf.path.tolist()).astype(np.int64).view(np.uint64), bits))
            word = (place >> np.uint64(6)).astype(np.int64)
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            yield pd.DataFrame({"word": word[begin], "bits": np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), begin).view(np.int64)})

    said = each.where("path is not null").select("path").mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, "<u8")
    out[said["word"].to_numpy()] = said["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def judged(documents: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, source (trimmed, lower case), cut, log_odds of the values of a column of every document.

    Null, empty and blank values are not cut and have null log-odds.  Words,
    states and contexts are counted over all values, by all tasks, in two
    readings: the first gives words, states and the ends to be judged, the second
    the counts of the contexts of those ends.  All values are judged before the
    threshold of each language is set.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "truncation")
    kind = documents.schema["doc_id"].dataType.simpleString()
    language = F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "^[a-z]{2}", 0).alias("language")
    named = F.col("doc_id").isNotNull().alias("named")
    texts = documents.select(F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id"), named, F.col(column).alias("text"), "source_type", F.lower(F.trim("source")).alias("source"), language)
    read = scratch.cut(texts.mapInPandas(_first_reading, f"what byte, doc_id {kind}, source string, language string, kind byte, state string, tail string, last string, word long, count long, first long, free boolean"))
    number: dict[int, Counter[str]] = {w: Counter() for w in (END, CUT, TOTAL)}
    for r in read.where(F.col("what").isin(END, CUT, TOTAL)).groupBy("what", "state").agg(F.sum("count").alias("n")).collect():
        number[r["what"]][r["state"]] = r["n"]
    total, weight = sum(number[TOTAL].values()), state_weights(number[END], number[CUT])
    frequent = read.where(F.col("what") == WORD).groupBy("word").agg(F.sum("count").alias("count"), F.sum("first").alias("first"), F.max("free").alias("free")).where(F.col("count") >= max(5, WORD_SHARE * total))
    known = spark.sparkContext.broadcast(known_words(frequent.toArrow().to_pandas(), total))

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = np.flatnonzero(pdf.kind.to_numpy() >= 0)
            kinds = pdf.kind.to_numpy()[some]
            path = pd.Series([None] * len(pdf), dtype=object)
            odds, middle = np.full((2, len(pdf)), np.nan)
            own = np.zeros(len(pdf), np.int8)
            for k in range(0, len(some), 1000):
                rows = some[k : k + 1000]
                for i, p in zip(rows.tolist(), paths(pdf["tail"].iloc[rows].tolist(), kinds[k : k + 1000].tolist(), known.value)):
                    path.iat[i] = p.view(np.int64)
            sure = are_known(pdf["last"].iloc[some].tolist(), known.value)
            odds[some] = [weight[s] for s in pdf.state.iloc[some].tolist()]
            of = zip(kinds.tolist(), pdf["tail"].iloc[some].tolist(), pdf["last"].iloc[some].tolist(), pdf["free"].iloc[some].tolist(), sure.tolist())
            own[some] = [sum(own_counts(KINDS[k], *x)) for k, *x in of]
            middle[some] = [threshold(KINDS[k], s) for k, s in zip(kinds.tolist(), sure.tolist())]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "language": pdf.language, "path": path, "key": [0 if p is None else int(p[-1]) for p in path], "own": own, "weight": odds, "middle": middle})

    ends = scratch.cut(read.where(F.col("what") == DOCUMENT).select("doc_id", "source", "language", "kind", "state", "tail", "last", "free").mapInPandas(end, f"doc_id {kind}, source string, language string, path array<long>, key long, own byte, weight double, middle double"))
    wanted = spark.sparkContext.broadcast(bitmap(ends, sum(number[END].values())))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            code = (pdf.source_type == "code").tolist()
            for some in chunks([plain(t) for t in pdf.text.tolist()], code):
                held.append(context_counts(some, known.value, wanted.value))
                rows += len(held[-1])
                if rows > HELD:
                    held = [added(held)]
                    rows = len(held[0])
                    if rows > HELD // 2:
                        yield signed(held[0])
                        held, rows = [], 0
        if held:
            yield signed(added(held))

    def signed(each: pd.DataFrame) -> pd.DataFrame:
        return each.assign(context=each.context.to_numpy().view(np.int64))

    def odds_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = zip(pdf.own.tolist(), pdf.ended.tolist(), pdf.seen.tolist())
            yield pd.DataFrame({"key": pdf["key"], "own": pdf.own, "odds": [log_odds(zip(e, n), (int(o == 2), int(o > 0))) for o, e, n in each]})

    counted = texts.where(F.col("text").isNotNull()).select("text", "source_type").mapInPandas(count, "context long, depth byte, ended long, seen long")
    counts = counted.groupBy("context").agg(F.max("depth").alias("depth"), F.sum("ended").alias("ended"), F.sum("seen").alias("seen")).where((F.col("seen") >= LEAST) | (F.col("depth") == 0))
    nodes = ends.where("path is not null").groupBy("key", "own").agg(F.first("path").alias("path")).select("key", "own", F.explode("path").alias("context"))
    found_counts = nodes.join(counts, "context").groupBy("key", "own").agg(F.sort_array(F.collect_list(F.struct("depth", "ended", "seen"))).alias("c"))
    odds = found_counts.select("key", "own", F.col("c.ended").alias("ended"), F.col("c.seen").alias("seen")).mapInPandas(odds_of, "key long, own byte, odds double")
    value = (F.coalesce("odds", F.lit(0.0)) + F.col("weight")).alias("log_odds")
    has = F.col("path").isNotNull()
    each = scratch.cut(ends.join(odds, ["key", "own"], "left").select("doc_id", "source", "language", F.when(has, value).alias("log_odds"), F.when(has, value - F.col("middle")).alias("margin")))
    least = thresholds(each)
    at = F.coalesce(F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("language")], F.lit(0.0)) if least else F.lit(0.0)
    return each.select("doc_id", "source", F.coalesce(F.col("margin") < at, F.lit(False)).alias("cut"), "log_odds")


def thresholds(each: DataFrame) -> dict[str, float]:
    """The threshold of each language, from the margins of all its values; languages are two letters, so they are few."""
    bins = each.where(F.abs("margin") <= REACH + 2 * BIN).select("language", F.floor(F.col("margin") / BIN).cast("int").alias("bin"))
    near: dict[str, dict[int, int]] = {}
    for r in bins.groupBy("language", "bin").count().collect():
        near.setdefault(r["language"], {})[r["bin"]] = r["count"]
    many = {r["language"]: r["count"] for r in each.where(F.col("margin").isNotNull()).groupBy("language").count().collect()}
    return {x: valley(near.get(x, {})) if n >= FEW else 0.0 for x, n in many.items()}


def found(documents: DataFrame, column: str = "text") -> DataFrame:
    """doc_id of each document whose end is lost; repeated rows count once."""
    return judged(documents, column).where("cut").select("doc_id").distinct()


def report(documents: DataFrame, column: str = "text") -> DataFrame:
    """source, documents, cut, share: how often each source truncates."""
    each = judged(documents, column).groupBy("doc_id").agg(F.min("source").alias("source"), F.max("cut").alias("cut"))
    return each.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut")).withColumn("share", F.col("cut") / F.col("documents"))
