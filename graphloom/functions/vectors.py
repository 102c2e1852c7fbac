"""Vector arithmetic on array columns, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def scale(a: Column, by: Column) -> Column:
    return F.transform(as_double(a), lambda x: x * by)


def normalized(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, as_double(a)).otherwise(scale(a, F.lit(1.0) / n))


def blend(a: Column, b: Column, share: float) -> Column:
    """Normalised ``(1 - share) * a + share * b``, the second one padded or cut to the first's size."""
    fitted = F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.coalesce(F.try_element_at(as_double(b), i), F.lit(0.0)))
    return normalized(F.zip_with(as_double(a), fitted, lambda x, y: (1.0 - share) * x + share * y))


def mean_rows(rows: Column) -> Column:
    """Mean of each element over an array of equally long arrays."""
    first = F.transform(rows[0], lambda x: F.lit(0.0))
    total = F.aggregate(rows, first, lambda s, r: F.zip_with(s, r, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(rows))
