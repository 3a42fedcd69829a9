"""Vector expressions between two columns (for one fixed query vector see ``native.distance_to``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _doubles(c: Column | str) -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def _comparable(a: Column | str, b: Column | str) -> Column:
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    return F.coalesce((F.size(ca) > 0) & (F.size(ca) == F.size(cb)), F.lit(False))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    scale = norm(a) * norm(b)
    return F.when(_comparable(a, b) & (scale > 0), F.lit(1.0) - dot(a, b) / scale).otherwise(
        F.lit(K.MISSING_DISTANCE)
    )


def squared_l2(a: Column | str, b: Column | str) -> Column:
    diff = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.when(_comparable(a, b), _sum(diff)).otherwise(F.lit(K.MISSING_DISTANCE))


def usable_vector(c: Column | str) -> Column:
    """A vector that is present and holds only numbers."""
    v = F.col(c) if isinstance(c, str) else c
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))
