"""Vector functions as Spark columns; all arithmetic in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null when a vector has no length or the lengths of the arrays differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def _centres(a: Column, b: Column) -> tuple[Column, Column]:
    return (a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2, (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2


def centre_distance(a: Column, b: Column) -> Column:
    """Between the centres of two boxes."""
    x, y = _centres(a, b)
    return F.sqrt(x * x + y * y)


def spatial_relation(a: Column, b: Column) -> Column:
    """contains when very near, sequence when near and level, layout when near and in line; else null."""
    x, y = _centres(a, b)
    d = centre_distance(a, b)
    return F.when(d < 20, "contains").when((F.abs(y) < 30) & (d < 100), "sequence").when((F.abs(x) < 50) & (d < 100), "layout")
