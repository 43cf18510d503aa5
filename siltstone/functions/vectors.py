"""Similarity of vectors as Column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import as_col


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; vectors of unequal size are an error."""
    a, b = as_col(a), as_col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    differ = F.raise_error(F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" dimensions")))
    return F.when(F.size(a) == F.size(b), total).when(a.isNotNull() & b.isNotNull(), differ.cast("double"))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where either vector is zero. Norms may be given where they are stored."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    product = dot(a, b)  # of a zero vector too, so that unequal sizes never pass
    return F.when(length == 0, product * 0.0).otherwise(product / length)
