"""Vector distances as built-in expressions; components count as doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dotProduct")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, vector: list[float]) -> Column:
    return _sum(F.zip_with(a, literal(vector), lambda x, y: x.cast("double") * y))


def distance(a: Column, vector: list[float], metric: str = "cosine") -> Column:
    """The distance, the nearer the less: 1 - cosine, the euclidean one, or the negative inner product."""
    if metric == "cosine":
        norm = F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
        length = math.sqrt(sum(float(x) ** 2 for x in vector))
        return 1 - F.try_divide(dot(a, vector), norm * length)
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(a, literal(vector), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))
    if metric == "dotProduct":
        return -dot(a, vector)
    raise ValueError(f"unknown metric {metric}")


def farthest(threshold: float, metric: str) -> float:
    """The greatest distance that a threshold allows: a score (1 + cosine) / 2, a distance, or an inner product."""
    return {"cosine": 2 * (1 - threshold), "euclidean": threshold, "dotProduct": -threshold}[metric]
