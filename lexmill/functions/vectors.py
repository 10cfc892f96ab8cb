"""Vector expressions; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; null where it has none. The length is bound by a lambda, which computes it once a vector
    and not once an element."""
    return F.get(F.transform(F.array(length(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))), F.lit(0))
