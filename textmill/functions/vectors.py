"""Vector arithmetic on array columns, in double precision, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import _col


def _doubles(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """In [-1, 1]; 0 for null, empty, unequal, zero or non-finite vectors."""
    a, b = _doubles(a), _doubles(b)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    good = fit & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(good, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).otherwise(F.lit(0.0))


def normalize(a: Column | str) -> Column:
    """The unit vector; a zero or non-finite one comes back as it is."""
    v, n = _doubles(a), norm(a)
    return F.when((n > 0) & ~F.isnan(n) & (n != float("inf")), F.transform(v, lambda x: x / n)).otherwise(v)
