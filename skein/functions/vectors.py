"""Vector functions as columns, and an embedder that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double over the shorter of both lengths."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n).cast("array<double>"), F.slice(b, 1, n).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length, null where one is null."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def decayed(intrinsic: Column, hop: Column, is_stub: Column, decay: Column | float = 0.9, penalty: Column | float = 0.5) -> Column:
    """Propagated score: similarity, decay per hop, penalty for stubs."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return intrinsic * F.pow(as_col(decay), hop) * F.when(F.coalesce(is_stub, F.lit(False)), as_col(penalty)).otherwise(1.0)


def hash_embedding(text: str | None, dim: int = 64) -> list[float]:
    """Signed hashed words, normalised: similar word sets give similar vectors."""
    v = np.zeros(dim)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
    size = float(np.linalg.norm(v))
    return (v / size if size else v).astype(float).tolist()


def embedder(fn: Callable[[str | None], list[float]] = hash_embedding) -> Callable[[Column], Column]:
    """A column function that embeds text with ``fn``; the default needs no model."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(fn)

    return embed
