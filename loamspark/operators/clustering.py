"""Lloyd's k-means.  Centroids are k rows of d numbers: they travel as a literal, so that assignment needs
no join, and sums over points are combined before the shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import squared_distance


def _literal(centroids: list[list[float]]) -> Column:
    return F.array(*[F.array(*map(F.lit, map(float, c))) for c in centroids])


def _best(centroids: list[list[float]]) -> Column:
    """(distance, cluster) of x's nearest centroid; of equal distances the lowest number."""
    return F.array_min(F.transform(_literal(centroids), lambda c, i: F.struct(squared_distance(F.col("x"), c).alias("distance"), i.alias("cluster"))))


def nearest(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """points (id, x) with cluster and distance (squared); of equal distances the lowest number wins."""
    return points.withColumn("_best", _best(centroids)).select("id", "x", F.col("_best.cluster").alias("cluster"), F.col("_best.distance").alias("distance"))


def cluster_means(points: DataFrame) -> DataFrame:
    """points (cluster, x) to (cluster, dim, mean, n)."""
    return points.select("cluster", F.posexplode("x").alias("dim", "value")).groupBy("cluster", "dim").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def first_centroids(points: DataFrame, k: int, seed: int | None = None) -> list[list[float]]:
    """The k points with the smallest ids, or k drawn without replacement."""
    order = F.col("id") if seed is None else F.xxhash64("id", F.lit(seed))
    return [list(map(float, r["x"])) for r in points.orderBy(order, "id").limit(k).collect()]


def reseed(centroids: list[list[float]], cluster: int) -> list[float]:
    """For a cluster without points: the mean of three centroids, chosen by its number."""
    k = len(centroids)
    return np.mean([centroids[(cluster + i) % k] for i in range(3)], axis=0).tolist()


def update(points: DataFrame, centroids: list[list[float]], before: list[list[float]] | None = None) -> tuple[list[list[float]], bool]:
    """True means of the clusters, and whether a label differs from that by the centroids before (without them, True).

    One pass and one shuffle of partial sums; k * d rows come to the driver.
    """
    rows = points.select("x", _best(centroids)["cluster"].alias("cluster"))
    moved = F.lit(True) if before is None else F.col("cluster") != _best(before)["cluster"]
    each = rows.withColumn("moved", moved).select("cluster", "moved", F.posexplode("x").alias("dim", "value"))
    new: list[list[float] | None] = [None] * len(centroids)
    any_moved = False
    for r in each.groupBy("cluster", "dim").agg(F.avg("value").alias("mean"), F.bool_or("moved").alias("moved")).collect():
        if new[r["cluster"]] is None:
            new[r["cluster"]] = [0.0] * len(centroids[0])
        new[r["cluster"]][r["dim"]] = r["mean"]
        any_moved |= r["moved"]
    return [reseed(centroids, i) if c is None else c for i, c in enumerate(new)], any_moved


def kmeans(points: DataFrame, k: int, max_iter: int = 20, seed: int | None = None, centroids: list[list[float]] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """Labels (id, x, cluster, distance) and centroids, once no label changes or after max_iter updates.

    Centroids are literals and labels follow from them, so no lineage grows and nothing is stored.
    """
    centroids = centroids or first_centroids(points, k, seed)
    if not centroids:
        return points.select("id", "x", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance")), []
    before = None
    for _ in range(max_iter):
        new, moved = update(points, centroids, before)
        if not moved:
            break
        centroids, before = new, centroids
    return nearest(points, centroids), centroids
