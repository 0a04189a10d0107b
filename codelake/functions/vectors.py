"""Vector functions in double precision, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for null, zero or unequally long vectors."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm))
