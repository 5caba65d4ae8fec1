"""Vector functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 for unequal lengths, empty or null vectors and norms below 1e-12."""
    x, y = _d(a), _d(b)
    fine = (F.size(x) == F.size(y)) & (F.size(x) > 0) & (norm(x) >= 1e-12) & (norm(y) >= 1e-12)
    return F.when(fine, dot(x, y) / (norm(x) * norm(y))).otherwise(0.0)


def normalized(a: Column | str) -> Column:
    """The vector with norm 1; unchanged where its norm is at most 1e-12."""
    x = _d(a)
    n = norm(x)
    return F.when(n > 1e-12, F.transform(x, lambda v: v / n)).otherwise(x)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blob: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a binary."""
    return blob.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4"))


@F.pandas_udf(T.BinaryType())
def to_blob(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
