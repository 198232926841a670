"""Vector expressions on array columns, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; null on missing or unequal sizes, 0 on a zero vector."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(
        (F.size(a) == F.size(b)) & (F.size(a) > 0),
        F.when(length == 0, 0.0).otherwise(dot(a, b) / length),
    )


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def quantise(vector: Column, digits: int = 6) -> Column:
    """Round components the way vectors are written out."""
    return F.transform(vector, lambda x: F.round(x.cast("double"), digits).cast("float"))
