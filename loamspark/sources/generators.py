"""Seeded synthetic data, made where it is used: spark.range and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_int(most: int, seed: int) -> Column:
    """0 to most, each as likely; also delays."""
    return F.floor(F.rand(seed) * (most + 1)).cast("int")


def normal(mean: Column, sigma: Column, seed: int) -> Column:
    return F.randn(seed) * sigma + mean


def poisson(rate: float, seed: int, longest: int | None = None) -> Column:
    """Inverse of the distribution function over one uniform draw; ``longest`` bounds the table of its steps."""
    u, n = F.rand(seed), longest or int(rate + 12 * rate**0.5 + 20)
    total, term, steps = 0.0, 2.718281828459045**-rate, []
    for k in range(n):
        total += term
        steps.append(total)
        term *= rate / (k + 1)
    return F.aggregate(F.array(*map(F.lit, steps)), F.struct(u.alias("u"), F.lit(0).alias("k")), lambda s, x: F.struct(s["u"].alias("u"), (s["k"] + (s["u"] > x).cast("int")).alias("k")), lambda s: s["k"])


def gaussian_mixture(spark: SparkSession, n: int, dims: int = 3, clusters: int = 5, space: float = 100.0, sigma: tuple[float, float] = (2.5, 7.5), noise: float = 0.2, seed: int = 1) -> DataFrame:
    """(id, cluster, x): points about cluster means, and a share of uniform noise, cluster null."""
    hashed = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    rows = spark.range(n).withColumn("cluster", F.when(F.rand(seed) >= noise, uniform_int(clusters - 1, seed + 1)))
    spread = F.lit(sigma[0]) + hashed(F.col("cluster")) * (sigma[1] - sigma[0])
    x = [F.when(F.col("cluster").isNull(), F.rand(seed + 2 + d) * space).otherwise(normal(hashed(F.col("cluster"), F.lit(d)) * space, spread, seed + 100 + d)) for d in range(dims)]
    return rows.select("id", "cluster", F.array(*x).alias("x"))
