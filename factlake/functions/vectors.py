"""Column -> Column functions on vectors, and the default text embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length in float; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<float>")).otherwise(F.transform(v, lambda x: (x / n).cast("float")))


def align(v: Column, dim: int) -> Column:
    """Cut or filled with zeros to dim."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def validity(v: Column, dim: int, tolerance: float = 0.01) -> Column:
    """The first thing wrong with a vector, or null: dimension, NaN, infinity, zero, length."""
    return (
        F.when(v.isNull() | (F.size(v) != dim), "dimension")
        .when(F.exists(v, lambda x: F.isnan(x)), "nan")
        .when(F.exists(v, lambda x: F.abs(x) == float("inf")), "inf")
        .when(F.forall(v, lambda x: x == 0), "zero")
        .when(F.abs(norm(v) - 1) > tolerance, "norm")
    )


def hashed_embedding(words: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for an embedding model: signed hashed word counts, unit length. Any model can take its place as a pandas UDF."""

    @F.pandas_udf("array<float>")
    def add(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.asarray(h if h is not None else [], dtype=np.int64)
            v = np.bincount(h % dim, np.where(h >> 32 & 1, -1.0, 1.0), dim)
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return add(F.transform(words, lambda w: F.xxhash64(w)))
