"""Encoding of a whole corpus with a public tokenizer (problem 8).

The tiktoken library runs over a local rank file inside Arrow batches.  Long
texts are cut before a blank that follows a non-blank: no piece of the
pre-splitting pattern spans such a place, so the ids are those of the uncut
text.  Ids decode through raw bytes, so a text cut inside a character
round-trips.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every function here.
VOCABULARIES = os.environ.get("CHUNKLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is encoded in pieces.
PIECE = 50_000

_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = VOCABULARIES):
    """The tiktoken encoding of a rank file; one per Python worker."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, least: int = PIECE) -> Iterator[str]:
    """The text in pieces of at least `least` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > least:
        cut = _SAFE.search(text, start + least)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, least: int = PIECE) -> list[int]:
    """Ids of a text; null and empty give []; strings of special tokens are plain text."""
    if not text:
        return []
    enc = encoding(name, folder)
    if len(text) <= least:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, least) for i in enc.encode_ordinary(part)]


def encode_column(text: Column, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    """array<int> of ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pa.Array) -> pa.Array:
        offsets, parts = [0], []
        for t in texts.to_pylist():
            row = encode(t, name, folder)
            parts.append(np.asarray(row, np.int32))
            offsets.append(offsets[-1] + len(row))
        values = np.concatenate(parts) if parts else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return ids(text)


def decode_column(ids: Column, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    """The raw bytes of the ids; null ids give null."""

    @F.pandas_udf(T.BinaryType())
    def raw(rows: pd.Series) -> pd.Series:
        enc = encoding(name, folder)
        return rows.map(lambda r: None if r is None else enc.decode_bytes([int(i) for i in r]))

    return raw(ids)


def encoded(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, ids of every document; null and empty texts have the empty list."""
    return documents.select("doc_id", encode_column(F.col("text"), name, folder).alias("ids"))
