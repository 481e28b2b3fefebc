"""Cosine similarity as an expression over arrays, and for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to the single-precision epsilon count as it, so that a zero vector has similarity 0.
EPS = float(np.finfo(np.float32).eps)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(EPS))


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; null if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def percent(score: Column) -> Column:
    """[-1, 1] as a share of 100, half to even at two decimals."""
    return F.bround((score + 1) / 2 * 100, 2)


def cosine_similarity(query: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Of one vector with each row of a matrix."""
    if not isinstance(query, np.ndarray) or not isinstance(matrix, np.ndarray):
        raise TypeError("cosine_similarity takes arrays")
    if query.ndim != 1:
        raise ValueError("the query must be one vector")
    if matrix.ndim == 1:
        matrix = matrix.reshape(1, -1) if matrix.size else matrix.reshape(0, len(query))
    if matrix.ndim != 2:
        raise ValueError("the vectors must be a matrix")
    if not len(matrix):
        return np.zeros(0, query.dtype)
    if matrix.shape[1] != len(query):
        raise ValueError(f"dimensions differ: {len(query)} and {matrix.shape[1]}")
    least = np.finfo(query.dtype if np.issubdtype(query.dtype, np.floating) else np.float64).eps
    return np.clip(matrix @ query / (np.maximum(np.linalg.norm(matrix, axis=1), least) * max(np.linalg.norm(query), least)), -1, 1)
