"""Vector functions on ARRAY columns, in doubles inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions.compat import col


def _d(x: Column | str) -> Column:
    return col(x).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is 0; null where a vector is null or the lengths differ."""
    d = norm(a) * norm(b)
    return F.when(F.size(col(a)) != F.size(col(b)), F.lit(None)).when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def is_valid(a: Column | str) -> Column:
    """Not empty, all values finite."""
    inf = F.lit(float("inf"))
    return F.coalesce((F.size(col(a)) > 0) & F.forall(_d(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def normalized(a: Column | str) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, _d(a)).otherwise(F.transform(_d(a), lambda x: x / n))
