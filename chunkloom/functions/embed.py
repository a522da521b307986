"""Vectors of texts: the provider's interface, an offline provider, and vectors as bytes."""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


class Provider(Protocol):
    """What makes vectors: a name, a length, and vectors of a batch of texts."""

    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedGrams:
    """An offline provider: signed, hashed counts of letter trigrams and words, of length 1; empty texts give zeros."""

    model = "hashed-grams"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k, text in enumerate(texts):
            low = " ".join((text or "").lower().split())
            grams = [*(low[i : i + 3] for i in range(len(low) - 2)), *low.split()]
            if grams:
                codes = np.fromiter((zlib.crc32(g.encode("utf-8", "replace")) for g in grams), np.int64, len(grams))
                np.add.at(out[k], codes % self.dimensions, np.where(codes >> 31 & 1, 1.0, -1.0).astype(np.float32))
                size = np.linalg.norm(out[k])
                out[k] /= size if size else 1.0
        return out


def embedded(rows: DataFrame, text: str, provider: Provider, into: str = "embedding") -> DataFrame:
    """The rows with a vector of a text column, made in batches by the tasks; null texts have none."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        made = iter(provider.embed(texts[known].tolist()).tolist() if known.any() else [])
        return pd.Series([next(made) if k else None for k in known], dtype=object)

    return rows.withColumn(into, run(F.col(text)))


def unembedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (id, ...) without a vector (chunk_id, embedding), the most important first."""
    have = vectors.where(F.size("embedding") > 0).select(F.col("chunk_id").alias("id")).distinct()
    return chunks.join(have, "id", "left_anti").orderBy(F.desc("importance"), "id")


def stored(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (chunk_id, embedding, created_at, ...) by key: the latest of each chunk stays, of equal times the one of `new`."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in ("chunk_id", "_new")]
    best = F.max_by(F.struct(*others), F.struct("created_at", "_new")).alias("x")
    return both.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(best).select("chunk_id", "x.*")


@F.pandas_udf(BinaryType())
def packed(vector: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats; null stays null."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def unpacked(raw: pd.Series) -> pd.Series:
    """The vector of little-endian 32-bit floats; null where the bytes are no whole number of them."""
    return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())


def length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
