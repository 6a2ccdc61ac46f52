"""Vector functions over ARRAY<FLOAT> / ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def centroids(vectors: DataFrame, group: list[str], vector: str = "vector") -> DataFrame:
    """Element-wise mean per group: one partial sum per (group, position), no collecting."""
    parts = vectors.select(*group, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(*group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # at most one entry per dimension, so the list below is as short as one vector
    rows = means.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("ps"))
    return rows.select(*group, F.transform("ps", lambda p: p["x"]).alias("centroid"))


def cluster_id(members: Column) -> Column:
    """Stable id of a member set given as an array of ids."""
    joined = F.array_join(F.array_sort(members), ",")
    return F.concat(F.lit("cluster-"), F.substring(F.sha1(joined), 1, 12))
