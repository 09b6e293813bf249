"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the defaults of the ranking function
K, B = 0.9, 0.4


def idf(n: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)); negative for a term in more than half of the pages."""
    return F.ln((n.cast("double") - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturation(freq: Column, length: Column, mean: Column, k: float = K, b: float = B) -> Column:
    """f (k + 1) / (f + k ((1 - b) + b dl / avgdl))."""
    return freq * F.lit(k + 1) / (freq + F.lit(k) * (F.lit(1 - b) + F.lit(b) * length / mean))


def bm25(freq: Column, df: Column, length: Column, n: Column, mean: Column, k: float = K, b: float = B) -> Column:
    return idf(n, df) * saturation(freq, length, mean, k, b)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision; for few pairs. Many pairs go through operators.vector."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def reciprocal_rank(rank: Column, n: int) -> Column:
    """1 / rank of the relevant item, 0 where it is missing or beyond ``n``."""
    return F.when(rank <= n, 1.0 / rank).otherwise(F.lit(0.0))
