"""Vector functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; the longer vector is cut, and a vector of length 0 gives 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, 1, n), lambda e: e.cast("double")) for v in (a, b))
    dot = _sum(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(_sum(F.transform(x, lambda p: p * p))) * F.sqrt(_sum(F.transform(y, lambda p: p * p)))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def literal(vector: list[float]) -> Column:
    if not vector:
        raise ValueError("the query's embedding is empty")
    return F.array(*(F.lit(float(x)) for x in vector))
