"""Boxes, vectors and small arithmetic. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let


def rect(bbox: Column) -> Column:
    """struct<left, top, right, bottom> of a box of points."""
    xs, ys = F.transform(bbox, lambda p: F.get(p, 0).cast("double")), F.transform(bbox, lambda p: F.get(p, 1).cast("double"))
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_column(low), F.least(as_column(high), c))


def rounded_box(bbox: Column) -> Column:
    """Points as integers; halves go to the even neighbour."""
    return F.transform(bbox, lambda p: F.transform(p, lambda v: F.bround(v).cast("int")))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    """A vector over its length; the zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(length, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def scaled_rect(box: Column, scale_x: Column, scale_y: Column) -> Column:
    """A box's rectangle on a screen: struct<left, top, width, height>."""
    r = rect(box)
    return F.struct((r["left"] * scale_x).alias("left"), (r["top"] * scale_y).alias("top"), ((r["right"] - r["left"]) * scale_x).alias("width"), ((r["bottom"] - r["top"]) * scale_y).alias("height"))
