"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citesieve.functions.text import col


def dot(a, b) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(v) -> Column:
    """Divide by the Euclidean norm; a zero vector is returned as it is."""
    vector = col(v)
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(vector, lambda x: x.cast("double")))


def is_finite_vector(v) -> Column:
    bad = F.exists(col(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(col(v)) > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True))


def softmax(logits) -> Column:
    """Stable softmax over an array of logits."""
    values = F.transform(col(logits), lambda x: x.cast("double"))
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)
