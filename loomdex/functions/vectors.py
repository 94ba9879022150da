"""Vector expressions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if sizes differ, null if a norm is 0."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b))).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def score_of_distance(d: Column) -> Column:
    """Distance 0 to 2 as score 1 to 0."""
    return 1 - d / 2


def score_of_rank(rank: Column) -> Column:
    return F.abs(rank) / (1 + F.abs(rank))


def valid(v: Column, dims: int) -> Column:
    """Of the right size, with finite numbers only."""
    return (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def softmax_weight(distance: Column, lowest: Column, temperature: float) -> Column:
    return F.exp(-(distance - lowest) / temperature)
