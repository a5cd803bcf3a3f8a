"""What the operators on embeddings share: rows of numbers as rows of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable() -> Column:
    """A vector that is there, without null or non-finite components."""
    inf = float("inf")
    return F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))


def whole(vectors: DataFrame, scale: int, most: int, *keep: str) -> DataFrame:
    """keep and x: floor(scale * component) as an int, for usable vectors only. Products beyond most or -most are taken as
    most or -most, so that sums stay within a long."""
    bounded = lambda x: F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(most))), F.lit(float(-most)))
    return vectors.where(usable()).select(*keep, F.transform("embedding", lambda x: F.floor(bounded(x)).cast("int")).alias("x"))


def widest(rows: DataFrame) -> int | None:
    """Components of the longest x; None without rows."""
    return rows.agg(F.max(F.size("x"))).first()[0]


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of ints as the rows of a matrix; shorter ones are filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return values.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out
