"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for vectors of unequal length, empty ones and zero vectors; norms may be given where they are known."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def centroids(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector of each group as rows (*by, pos, value): sums are combined before the shuffle."""
    return df.select(*by, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("value"))


def gathered(parts: DataFrame, by: list[str], vector: str = "centroid") -> DataFrame:
    """Rows (*by, pos, value) as one array for each group; a vector's length bounds it."""
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias(vector))
