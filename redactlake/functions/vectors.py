"""Vectors as arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """-1 if a length is (almost) zero."""
    scale = norm(a) * norm(b)
    return F.when(scale <= 1e-8, -1.0).otherwise(dot(a, b) / scale)


def unit(a: Column) -> Column:
    """The direction; null if there is none."""
    n = norm(a)
    return F.when((n > 1e-8) & ~F.isnan(n) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n))


def centroid(rows: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """keys, pos, value: the (weighted) mean of the vectors of each key, by component; partial sums before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    each = rows.select(*keys, w.alias("_w"), F.posexplode(vector).alias("pos", "_x"))
    return each.groupBy(*keys, "pos").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("value"))
