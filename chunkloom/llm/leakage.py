"""Evaluation texts leaking into training text (problem 9).

The words of all test items form one generalised suffix automaton.  Each
document's words are streamed through it; the automaton's state gives the
longest match that ends at each word and which items hold it.  Matches of one
item add up over a window as long as the item with its additions can be; where
they cover enough of the item, a local alignment decides exactly how many of its
words stand there in order, and where the span begins and ends.  Words added all
along a long item shift its later matches as far as they like, since the window
asks for no diagonal.

The items are put in blocks by hash and each block's automaton is built in a
task.  The documents are read once for as many automata as BROADCAST_BYTES
holds.

Words are runs of letters and digits after unescaping and case folding, so case,
spacing, line breaks, punctuation, markup, quoting and escapes do not matter.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.common import Scratch

#: Shortest match that counts as a seed, in words.
SEED = 5
#: Share of an item's words that the seeds of a window must cover before it is aligned.
SEED_COVER = 0.3
#: Share of an item's words that a document must hold.
HOLD = 0.5
#: What a changed, added or missing word costs in the alignment, in matched words.  As it is SEED - 1, nothing before the first and after the last seed can raise an alignment.
COST = 4
#: Words before the first and after the last seed that are aligned too, for the ties.
MARGIN = 32
#: Seeds of a stretch up to which their best chain is looked for first; a stretch of more is aligned at once.
CHAINED = 3000
#: Characters of the items that share one automaton; more items make further automata.
ITEM_CHARS = 1_200_000
#: Bytes of automata that are broadcast for one reading of the documents.
BROADCAST_BYTES = 1 << 30
#: Characters of documents that a task holds while it goes through the automata, where there are several.
HELD_CHARS = 8_000_000

_WORD = re.compile(r"[^\W_]+")
_ESCAPED = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|[nrtbf])")
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]{0,10}(?:\s[^<>]{0,200})?/?>")


def plain(text: str) -> str:
    """The text without escapes, entities and tags, of the same words otherwise."""
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text


def words(text: str | None) -> list[str]:
    """Case-folded words of a text; none for null."""
    return _WORD.findall(plain(text).casefold()) if text else []


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences.

    `trans`, `link` and `length` are those of the automaton; `count[v]` is the
    number of places of state v.  `places[v]` has item, end and longest length
    of each place of v and its suffixes of SEED words or more.
    """

    vocabulary: dict[str, int]
    items: list[np.ndarray]
    trans: list[dict[int, int]]
    link: list[int]
    length: list[int]
    count: list[int]
    places: dict[int, np.ndarray]


def build(items: list[list[str]]) -> Automaton:
    """The automaton of the items' words."""
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in item], np.int64) for item in items]
    trans: list[dict[int, int]] = [{}]
    link, length, own = [-1], [0], [None]
    last = 0
    for k, item in enumerate(coded):
        for place, symbol in enumerate([*item.tolist(), -2 - k]):  # a symbol of its own ends each item
            new = len(trans)
            trans.append({})
            link.append(0)
            length.append(length[last] + 1)
            own.append((k, place) if symbol >= 0 else None)
            at = last
            while at >= 0 and symbol not in trans[at]:
                trans[at][symbol] = new
                at = link[at]
            if at >= 0:
                to = trans[at][symbol]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    clone = len(trans)
                    trans.append(dict(trans[to]))
                    link.append(link[to])
                    length.append(length[at] + 1)
                    own.append(None)
                    while at >= 0 and trans[at].get(symbol) == to:
                        trans[at][symbol] = clone
                        at = link[at]
                    link[to] = link[new] = clone
            last = new
    ends: list[list[tuple[int, int]]] = [[o] if o else [] for o in own]
    for v in sorted(range(1, len(trans)), key=length.__getitem__, reverse=True):
        if link[v] > 0 and length[link[v]] >= SEED:
            ends[link[v]] += ends[v]
    places = {}
    for v in sorted(range(1, len(trans)), key=length.__getitem__):
        if length[v] >= SEED and (ends[v] or link[v] in places):
            held = set(ends[v])
            rows = [(k, e, length[v]) for k, e in sorted(held)]
            if link[v] in places:
                rows += [(k, e, n) for k, e, n in places[link[v]].tolist() if (k, e) not in held]
            places[v] = np.array(rows, np.int32)
    return Automaton(vocabulary, coded, trans, link, length, [len(e) for e in ends], places)


def events(auto: Automaton, ids: list[int]) -> list[tuple[int, int, int]]:
    """(state, length, place) wherever a match of SEED words or more ends for at least one item."""
    trans, link, length, count = auto.trans, auto.link, auto.length, auto.count
    out, v, n = [], 0, 0
    for i, w in enumerate(ids):
        to = trans[v].get(w)
        if to is not None:
            if n >= SEED and count[to] < count[v]:
                out.append((v, n, i - 1))
            v, n = to, n + 1
            continue
        if n >= SEED:
            out.append((v, n, i - 1))
        while v and to is None:
            v = link[v]
            to = trans[v].get(w)
        if to is None:
            v = n = 0
        else:
            n = length[v] + 1
            v = to
    if n >= SEED:
        out.append((v, n, len(ids) - 1))
    return out


def align(item: np.ndarray, ids: np.ndarray) -> tuple[int, int]:
    """Words of the item in the best local alignment with a document's words, and its end there.

    A match gives 1, any changed, added or missing word costs COST.  The number
    of matches rides in the low digits of the score.
    """
    one, gap = 1 << 20, COST << 20
    slope = gap * np.arange(len(ids) + 1, dtype=np.int64)
    row, t = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64)
    best, end = 0, 0
    for w in item.tolist():
        np.add(row[:-1], np.where(ids == w, one + 1, -gap), out=t[1:])
        row -= gap
        np.maximum(t, row, out=t)
        t += slope
        np.maximum.accumulate(t, out=t)
        t -= slope
        t[t < one] = 0
        row, t = t, row
        t[0] = 0
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best & (one - 1), end


def windows(sizes: np.ndarray, pair: np.ndarray, n: np.ndarray, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(pair, first, last + 1) of the stretches of documents whose seeds cover enough of an item.

    A seed is n words of pair (document * items + item) that end at `at` in the
    document and at `place` in the item.  Each window reaches back from a seed by
    the item's length and a quarter, more than one added word in eight;
    overlapping windows are one stretch, whose best chain must cover enough too.
    """
    start = at - n + 1
    order = np.lexsort((start, pair))
    pair, start, at, n, place = pair[order], start[order], at[order], n[order], place[order]
    wide = int(at.max()) + 2
    base = pair * wide
    begin, end = base + start, base + at + 1
    reach = np.maximum.accumulate(end)
    fresh = np.maximum(0, end - np.maximum(np.r_[0, reach[:-1]], begin))
    total = np.cumsum(fresh)
    size = sizes[pair % len(sizes)]
    left = np.searchsorted(begin, np.maximum(begin - (size + size // 4 + MARGIN), base))
    cover = total - total[left] + fresh[left]
    spans: list[list[int]] = []
    for k in np.flatnonzero(cover >= SEED_COVER * size).tolist():
        lo = int(left[k])
        if spans and pair[spans[-1][0]] == pair[k] and begin[lo] <= reach[spans[-1][1]] + 2 * MARGIN:
            spans[-1] = [min(lo, spans[-1][0]), k]
        else:
            spans.append([lo, k])
    for lo, k in spans:
        some = slice(lo, k + 1)
        if k - lo >= CHAINED or chain(n[some], at[some], place[some]) >= SEED_COVER * size[k]:
            yield int(pair[k]), max(0, int(start[lo]) - MARGIN), int(reach[k] - base[k]) + MARGIN


def chain(n: np.ndarray, at: np.ndarray, place: np.ndarray) -> int:
    """Words of the seeds that the best chain takes, in the order of document and item.

    Going from one seed to the next costs at least as much as the words that
    are missing or added between them, or one changed word.
    """
    order = np.lexsort((place, at))
    n, at, place = n[order], at[order], place[order]
    score, held = n.copy(), n.copy()
    for k in range(1, len(n)):
        gain = np.minimum(n[k], np.minimum(at[k] - at[:k], place[k] - place[:k]))
        drift = np.abs((at[k] - place[k]) - (at[:k] - place[:k]))
        through = np.where(gain > 0, score[:k] + gain - COST * np.maximum(drift, 1), 0)
        best = int(through.argmax())
        if through[best] > n[k]:
            score[k], held[k] = through[best], held[best] + gain[best]
    return int(held[score.argmax()])


def _aligned(item: np.ndarray, ids: np.ndarray, at: int, spans: bool) -> Iterator[tuple[int, int, int]]:
    """(words held, first, last + 1) of each passage of words from place `at` on that holds the item."""
    if len(ids) < HOLD * len(item):
        return
    held, end = align(item, ids)
    if held < HOLD * len(item):
        return
    if not spans:
        yield held, at, at + end
        return
    first = end - align(item[::-1], ids[:end][::-1])[1]
    yield from _aligned(item, ids[:first], at, True)
    yield held, at + first, at + end
    yield from _aligned(item, ids[end:], at + end, True)


def leaks(auto: Automaton, documents: list[list[int]], spans: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(document, item, words held, first, last + 1) of each passage of a document with at least HOLD of an item's words.

    Seeds of all documents of a batch are put together in one go.  Without
    `spans`, first is not worked out and one passage of a stretch is enough.
    """
    hits = [(d, v, n, at) for d, ids in enumerate(documents) for v, n, at in events(auto, ids)]
    if not hits:
        return []
    doc, state, n, at = np.array(hits, np.int64).T
    parts = [auto.places[v] for v in state.tolist()]
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts).astype(np.int64)
    sizes = np.fromiter(map(len, auto.items), np.int64, len(auto.items))
    pair, n, at = np.repeat(doc, lens) * len(sizes) + flat[:, 0], np.minimum(flat[:, 2], np.repeat(n, lens)), np.repeat(at, lens)
    out = []
    for p, lo, hi in windows(sizes, pair, n, at, flat[:, 1]):
        d, i = divmod(p, len(sizes))
        out += [(d, i, *x) for x in _aligned(auto.items[i], np.array(documents[d][lo:hi], np.int64), lo, spans)]
    return out


def _automata(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """bytes: the pickled (item ids, automaton) of each block of items; repeated rows count once."""
    some = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t")).distinct()
    chars = some.agg(F.sum(F.length("t"))).first()[0] or 0

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {(i, tuple(w)) for i, w in zip(pdf.i.tolist(), map(words, pdf.t.tolist())) if len(w) >= SEED}
        rows = sorted(held)
        blobs = [pickle.dumps(([i for i, _ in rows], build([list(w) for _, w in rows])), 5)] if rows else []
        return pd.DataFrame({"bytes": blobs})

    block = F.pmod(F.xxhash64("i"), F.lit(chars // ITEM_CHARS + 1))
    return some.withColumn("block", block).groupBy("block").applyInPandas(make, "bytes binary")


def _rounds(documents: DataFrame, items: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """Lists of broadcast automata, each to be used in one reading of the documents."""
    spark = documents.sparkSession
    built = Scratch(spark, "automata").cut(_automata(items, item_id, text))
    held, size = [], 0
    for row in built.toLocalIterator():
        if held and size + len(row[0]) > BROADCAST_BYTES:
            yield held
            held, size = [], 0
        held.append(spark.sparkContext.broadcast(bytes(row[0])))
        size += len(row[0])
    if held:
        yield held


def _scanned(batches: Iterator[pd.DataFrame], shared: list, spans: bool) -> Iterator[tuple[pd.DataFrame, list]]:
    """Documents (with column t) and their leaks (row, item id, words held, first, last + 1), batch by batch."""
    one = pickle.loads(shared[0].value) if len(shared) == 1 else None

    def through(pdf: pd.DataFrame) -> list:
        texts = [words(t) for t in pdf.t.tolist()]
        rows = []
        for b in shared:
            names, auto = one or pickle.loads(b.value)
            code = auto.vocabulary.get
            rows += [(d, names[i], *x) for d, i, *x in leaks(auto, [[code(w, -1) for w in t] for t in texts], spans)]
        return rows

    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += int(pdf.t.str.len().sum())
        if one or size >= HELD_CHARS:
            both = pd.concat(held, ignore_index=True)
            yield both, through(both)
            held, size = [], 0
    if held:
        both = pd.concat(held, ignore_index=True)
        yield both, through(both)


def passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, item_id, words_held, first_word, last_word (exclusive) of each passage that holds an item.

    An item leaks into a document that holds at least HOLD of its words, in its
    order, in one passage with about one word in eight changed or added.  Null
    and empty texts hold nothing; items of fewer than SEED words cannot be told
    from chance and leak nowhere.  Word numbers are those of `words`.
    """
    kind, item_kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"d {kind}, i {item_kind}, words_held int, first_word int, last_word int"
    some = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    out = documents.sparkSession.createDataFrame([], schema)
    for shared in _rounds(documents, items, item_id, item_text):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf, rows in _scanned(batches, shared, spans):
                ids = pdf.d.tolist()
                yield pd.DataFrame([(ids[d], *x) for d, *x in rows], columns=["d", "i", "words_held", "first_word", "last_word"])

        out = out.unionByName(some.mapInPandas(run, schema))
    return out.withColumnsRenamed({"d": doc_id, "i": item_id}).distinct()


def found(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, item_id, words_held, first_word, last_word of the best passage of each leak; see `passages`."""
    best = F.max(F.struct("words_held", "first_word", "last_word")).alias("x")
    each = passages(documents, items, doc_id, text, item_id, item_text, spans)
    return each.groupBy(doc_id, item_id).agg(best).select(doc_id, item_id, "x.*")


def without_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 0) -> DataFrame:
    """doc_id, text, removed (words): each document without the passages, of at least `least` words, that hold an item.

    All else in the text stays as it is, markup and escapes included.  Null texts
    stay null, with 0 removed.  Repeated rows stay repeated.
    """
    schema = f"d {documents.schema[doc_id].dataType.simpleString()}, t string, removed int"
    out = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.lit(0).alias("removed"))
    for shared in _rounds(documents, items, item_id, item_text):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf, rows in _scanned(batches, shared, True):
                spans: dict[int, list] = {}
                for d, _, _, a, b in rows:
                    if b - a >= least:
                        spans.setdefault(d, []).append((a, b))
                texts, removed = pdf.t.tolist(), pdf.removed.tolist()
                for d, held in spans.items():
                    texts[d] = scrub(texts[d], held)
                    removed[d] += sum(b - a for a, b in _merged(held))
                yield pd.DataFrame({"d": pdf.d, "t": texts, "removed": removed})

        out = out.mapInPandas(run, schema)
    return out.withColumnsRenamed({"d": doc_id, "t": text})


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_CLUSTER, _RUN = regex.compile(r"\X"), re.compile(r"\S+")


def placed(text: str) -> tuple[str, list[int], list[int]]:
    """What `plain` gives, and where each of its characters begins and ends in the text itself."""
    begin, end = list(range(len(text))), list(range(1, len(text) + 1))

    def put(pattern, new) -> None:
        nonlocal text, begin, end
        parts, b, e, at = [], [], [], 0
        for m in pattern.finditer(text):
            i, j = m.span()
            said = new(m)
            parts += [text[at:i], said]
            b += begin[at:i] + [begin[i]] * len(said)
            e += end[at:i] + [end[j - 1]] * len(said)
            at = j
        text, begin, end = "".join(parts) + text[at:], b + begin[at:], e + end[at:]

    whole = plain(text)
    if "\\" in text:
        put(_ESCAPED, lambda m: chr(int(m[1], 16)) if m[1] else " ")
    if "&" in text:
        put(_ENTITY, lambda m: html.unescape(m[0]))
    if "<" in text:
        put(_TAG, lambda m: " ")
    if text != whole:
        held = text, begin, end
        put(_CLUSTER, lambda m: unicodedata.normalize("NFKC", m[0]))
        if text != whole:
            text, begin, end = held
            put(_RUN, lambda m: unicodedata.normalize("NFKC", m[0]))
    return text, begin, end


def scrub(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words first..last - 1 of each span; all other characters stay.

    Word numbers are those of `words`.  Null stays null.
    """
    if not text or not spans:
        return text
    flat, begin, end = placed(text)
    at = [m.span() for m in _WORD.finditer(flat)]
    for a, b in reversed(_merged(spans)):
        text = text[: begin[at[a][0]]] + text[end[at[b - 1][1] - 1] :]
    return text
