"""Similarity and ranking scores as double arithmetic on arrays."""

from __future__ import annotations

import hashlib
import math
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import days_between, tier_bonus


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either is null; 0 for different lengths or a zero vector."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(_dot(a, b) / norms)


def composite_score(similarity: Column, as_of: Column) -> Column:
    """Similarity plus importance, tier, feedback, confidence and recency, on a memories row."""
    importance = F.least(F.greatest(F.col("importance"), F.lit(0)), F.lit(10)) / F.lit(10.0) * F.lit(0.25)
    days = days_between(as_of, F.coalesce("last_accessed", "created_at"))
    return (
        similarity + importance + tier_bonus(F.col("tier")) + F.coalesce(F.col("feedback_score"), F.lit(0)) * F.lit(0.1)
        + F.coalesce(F.col("confidence_score"), F.lit(0.7)) * F.lit(0.1) + F.lit(0.15) / (F.lit(1.0) + days * F.lit(0.005))
    )


def filled(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as the rows of a matrix, shorter ones filled up with zeros, and their lengths. A null component is no
    number: such a row is like nothing, not even to itself."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out, sizes


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Offline and deterministic: signed feature hashing of words, normalised."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dims
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


def embedding_text() -> Column:
    return F.format_string("%s: %s [context: %s]", F.col("type"), F.col("content"), F.coalesce("context", F.lit("")))


def embed_column(embedder: Embedder):
    """A vectorised function from text to array<float>."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.fillna("").tolist()))

    return run
