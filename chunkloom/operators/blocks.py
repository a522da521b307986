"""Blocks of an inverted index as arrays, and the best rows of many queries in them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd

#: Rows and postings that are scored at once, rows that give the first bounds, rows handed on at once; scores are compared to so many digits.
BLOCK_ROWS, BLOCK_POSTINGS, FIRST_ROWS, OUT_ROWS = 1 << 16, 1 << 22, 1 << 13, 1 << 17
DIGITS, SLACK = 9, 1e-9
#: A list so many times longer than the rows in question is searched rather than added up.
LONGER = 16

WORDS = re.compile(r"[a-z0-9]+").findall
BLOCK = "n long, words long, ids binary, ties binary, lens binary, terms binary, starts binary, docs binary, kinds binary, one binary, heavy binary"
FOUND = "query_id long, id long, one double, heavy double"


def _width(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def cut(pdf: pd.DataFrame, code: dict[str, int], weights: list[float]) -> dict:
    """One block of rows (id, tie, a lower-case text per field f0, f1, ...): the postings of the terms in `code`, by term and row.

    Postings with equal counts in all fields are of one kind; a kind has its count and its weighted count.
    """
    n, lens, keys = len(pdf), np.zeros(len(pdf), np.int64), []
    for k in range(len(weights)):
        words = [WORDS(t) for t in pdf[f"f{k}"]]
        sizes = np.fromiter(map(len, words), np.int64, n)
        lens += sizes
        codes = np.fromiter(map(code.get, chain.from_iterable(words), repeat(-1)), np.int64, int(sizes.sum()))
        key = codes * n + np.repeat(np.arange(n), sizes)
        keys.append(key[codes >= 0])
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = [np.bincount(x, minlength=len(key)) for x in np.split(at, np.cumsum([len(x) for x in keys])[:-1])]
    kind, kinds = np.zeros(len(key), np.int64), 1
    for c in counts:
        several = int(c.max(initial=0)) + 1
        if kinds * several >= 1 << 62:
            _, kind = np.unique(kind, return_inverse=True)
            kinds = len(key) + 1
        kind, kinds = kind * several + c, kinds * several
    _, first, kind = np.unique(kind, return_index=True, return_inverse=True)
    terms, starts = np.unique(key // n, return_index=True)
    return {
        "n": n, "words": int(lens.sum()), "ids": pdf.id.to_numpy(np.int64).tobytes(), "ties": pdf.tie.to_numpy(np.int64).tobytes(), "lens": lens.tobytes(),
        "terms": terms.astype(np.int32).tobytes(), "starts": starts.astype(np.int64).tobytes(), "docs": (key % n).astype(_width(n)).tobytes(), "kinds": kind.astype(_width(len(first))).tobytes(),
        "one": sum(c[first] for c in counts).astype(np.float64).tobytes(), "heavy": sum(w * c[first] for w, c in zip(weights, counts)).astype(np.float64).tobytes(),
    }


def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """term, df of blocks (terms, starts, docs, n)."""
    for pdf in batches:
        for b in pdf.itertuples():
            ends = np.append(np.frombuffer(b.starts, np.int64), len(b.docs) // np.dtype(_width(b.n)).itemsize)
            yield pd.DataFrame({"term": np.frombuffer(b.terms, np.int32).astype(np.int64), "df": np.diff(ends)})


def merged(batches: Iterator[pd.DataFrame], idf: np.ndarray, mean: float, k1: float, b: float) -> Iterator[tuple]:
    """Larger blocks: ids, ties, where each term's postings begin, rows, and both scores of the postings, by term and row."""
    held, rows, postings, most = [], 0, 0, FIRST_ROWS

    def joined() -> tuple:
        ids, ties = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        term = np.concatenate([h[2] for h in held])
        docs, one, heavy = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
        if len(held) > 1:
            order = np.argsort(term, kind="stable")  # within a term rows stay in order
            term, docs, one, heavy = term[order], docs[order], one[order], heavy[order]
        return ids, ties, np.searchsorted(term, np.arange(len(idf) + 1, dtype=np.int32)), docs, one, heavy

    for pdf in batches:
        for r in pdf.itertuples():
            docs = np.frombuffer(r.docs, _width(r.n)).astype(np.int32)
            one, heavy = np.frombuffer(r.one, np.float64), np.frombuffer(r.heavy, np.float64)
            kind = np.frombuffer(r.kinds, _width(len(one)))
            terms, starts = np.frombuffer(r.terms, np.int32), np.frombuffer(r.starts, np.int64)
            term = np.repeat(terms, np.diff(np.append(starts, len(docs))))
            norm = (k1 * (1 - b + b * np.frombuffer(r.lens, np.int64) / mean))[docs]
            score = [idf[term] * tf[kind] * (k1 + 1) / (tf[kind] + norm) for tf in (one, heavy)]
            if held and (rows + r.n > most or postings + len(docs) > BLOCK_POSTINGS):
                yield joined()
                held, rows, postings, most = [], 0, 0, min(BLOCK_ROWS, 4 * most)
            held.append((np.frombuffer(r.ids, np.int64), np.frombuffer(r.ties, np.int64), term, docs + np.int32(rows), *score))
            rows, postings = rows + r.n, postings + len(docs)
    if held:
        yield joined()


def _sums(rows: np.ndarray, lists: list[tuple], docs: np.ndarray, *scores: np.ndarray) -> list[np.ndarray]:
    """The sums of the lists' scores for some rows, always in the order of the lists."""
    out = [np.zeros(len(rows)) for _ in scores]
    for lo, hi in lists:
        at = np.searchsorted(docs[lo:hi], rows) + lo
        at[at == hi] = lo
        hit = docs[at] == rows
        for total, score in zip(out, scores):
            total += np.where(hit, score[at], 0.0)
    return out


def best(blocks: Iterator[tuple], queries: list[tuple[int, np.ndarray]], k: int, by: str) -> Iterator[pd.DataFrame]:
    """query_id, id, one, heavy of the k best rows of each query over all blocks, by score, then by smallest tie; rows equal in both to the last stay.

    A term whose list cannot lift a row over the k-th score known so far adds to
    rows of other terms only, and a query whose terms together cannot is passed over.
    """
    sizes = np.array([len(t) for _, t in queries])
    flat, begins = np.concatenate([t for _, t in queries]), np.append(0, np.cumsum(sizes)[:-1])
    least = np.full(len(queries), -np.inf)
    state: list = [None] * len(queries)
    for ids, ties, ptr, docs, one, heavy in blocks:
        main = one if by == "one" else heavy
        full = np.flatnonzero(np.diff(ptr))
        most = np.zeros(len(ptr) - 1)
        if len(full):
            most[full] = np.maximum.reduceat(main, ptr[full])
        there = np.add.reduceat((ptr[flat + 1] > ptr[flat]).astype(np.int64), begins) > 0
        total, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
        for q in np.flatnonzero(there & (np.add.reduceat(most[flat], begins) >= least - SLACK)):
            terms, floor = queries[q][1], least[q] - SLACK
            lists = [(ptr[t], ptr[t + 1], most[t]) for t in terms if ptr[t + 1] > ptr[t]]
            plain, rest = [x[:2] for x in lists], 0.0
            lists.sort(key=lambda x: x[2])
            weak = 0
            while weak < len(lists) - 1 and rest + lists[weak][2] < floor:
                rest += lists[weak][2]
                weak += 1
            strong = lists[weak:]
            if len(strong) == 1:
                rows, score = docs[strong[0][0] : strong[0][1]], main[strong[0][0] : strong[0][1]]
            else:
                for lo, hi, _ in strong:
                    total[docs[lo:hi]] += main[lo:hi]
                    seen[docs[lo:hi]] = True
                rows = np.flatnonzero(seen).astype(np.int32)
                score = total[rows]
                total[rows], seen[rows] = 0.0, False
            for i in range(weak - 1, -1, -1):
                keep = score + rest >= floor
                rows, score = rows[keep], score[keep]
                lo, hi, top = lists[i]
                if (hi - lo) > LONGER * len(rows):
                    score = score + _sums(rows, [(lo, hi)], docs, main)[0]
                else:
                    total[docs[lo:hi]] = main[lo:hi]
                    score = score + total[rows]
                    total[docs[lo:hi]] = 0.0
                rest -= top
            if len(score) > k:
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k] - 2 * SLACK)
            rows = rows[score >= floor]
            if not len(rows):
                continue
            a, b = _sums(rows, plain, docs, one, heavy)
            new = (np.round(a if by == "one" else b, DIGITS), ties[rows], ids[rows], a, b)
            if state[q] is not None:
                new = tuple(np.concatenate(x) for x in zip(state[q], new))
            order = np.lexsort((new[1], -new[0]))
            if len(order) > k:
                last = order[k - 1]
                few = k + int(np.searchsorted((new[0][order[k:]] != new[0][last]) | (new[1][order[k:]] != new[1][last]), True))
                order = order[:few]
            state[q] = tuple(x[order] for x in new)
            if len(order) >= k:
                least[q] = state[q][0][k - 1]
    held = [(q, x) for (q, _), x in zip(queries, state) if x is not None]
    step = max(1, OUT_ROWS // k)
    for some in (held[n : n + step] for n in range(0, len(held), step)):
        ids, a, b = (np.concatenate([x[n] for _, x in some]) for n in (2, 3, 4))
        yield pd.DataFrame({"query_id": np.repeat([q for q, _ in some], [len(x[0]) for _, x in some]), "id": ids, "one": a, "heavy": b})
