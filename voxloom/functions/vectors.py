"""Vector functions over array columns, as Column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

FLOOR = 1e-10
EDGE = 1e-7


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, floor: float = FLOOR) -> Column:
    """The vector over its norm, or over ``floor`` where that is larger."""

    def scaled(held: Column) -> Column:
        return F.transform(held["v"], lambda x: x / held["length"])

    # the length is bound once; inside the lambda it would be computed for each element
    return let(F.struct(as_double(v).alias("v"), F.greatest(norm(v), F.lit(floor)).alias("length")), scaled)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def distance(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def margin_logit(cosine: Column, is_target: Column, scale: float = 30.0, margin: float = 0.5) -> Column:
    """scale * cos(angle + margin) for the target class, scale * cos(angle) for others."""
    angle = F.acos(F.least(F.greatest(cosine, F.lit(-1 + EDGE)), F.lit(1 - EDGE)))
    return F.lit(scale) * F.cos(angle + F.when(is_target, F.lit(margin)).otherwise(0.0))
