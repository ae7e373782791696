"""Round trips of least cost and routes of greatest capacity, as joins level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut


def best_tours(dist: DataFrame, nodes: DataFrame | None = None, max_nodes: int = 15) -> DataFrame:
    """dist (case_id, src, dst, dist) to (case_id, cost, path): from the last node through each other one, and back.

    Dynamic programming over (set of visited nodes, last node); of equal costs the smallest path.  The number
    of states grows as n * 2**n for a case of n nodes, hence the bound, which fails loudly.
    """
    size = dist.groupBy("case_id").agg((F.max("src") + 1).alias("n"))
    most = size.agg(F.max("n")).first()[0] or 0
    if most > max_nodes:
        raise ValueError(f"a case has {most} nodes; the bound is {max_nodes}")
    edges = cut(dist.join(size, "case_id").select("case_id", "src", "dst", "dist", "n"))
    zero = F.lit(0).cast("long")
    now = size.select("case_id", "n", zero.alias("mask"), (F.col("n") - 1).alias("last"), F.struct(zero.alias("cost"), F.array((F.col("n") - 1).cast("int")).alias("path")).alias("best"))
    ends = None
    for level in range(most):
        done = now.where(F.col("n") == level + 1)
        ends = done if ends is None else ends.unionByName(done)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("dst").cast("int"))
        step = now.join(edges.drop("n").withColumnRenamed("src", "last"), ["case_id", "last"]).where((F.col("dst") < F.col("n") - 1) & (F.col("mask").bitwiseAND(bit) == 0))
        grown = F.struct((F.col("best.cost") + F.col("dist")).alias("cost"), F.concat("best.path", F.array(F.col("dst").cast("int"))).alias("path"))
        now = cut(step.select("case_id", "n", F.col("mask").bitwiseOR(bit).alias("mask"), F.col("dst").alias("last"), grown.alias("best")).groupBy("case_id", "n", "mask", "last").agg(F.min("best").alias("best")))
    if ends is None:
        return size.select("case_id", zero.alias("cost"), F.array().cast("array<int>").alias("path"))
    home = edges.where(F.col("dst") == F.col("n") - 1).select("case_id", F.col("src").alias("last"), F.col("dist").alias("back"))
    full = ends.join(home, ["case_id", "last"], "left").withColumn("back", F.when(F.col("n") == 1, 0).otherwise(F.col("back")))
    closed = F.struct((F.col("best.cost") + F.col("back")).alias("cost"), F.concat("best.path", F.array((F.col("n") - 1).cast("int"))).alias("path"))
    tours = full.groupBy("case_id").agg(F.min(closed).alias("best")).select("case_id", "best.cost", "best.path")
    if nodes is None:
        return tours
    names = nodes.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), "name"))).alias("names"))
    return tours.join(names, "case_id").select("case_id", "cost", F.transform("path", lambda i: F.col("names")[i]).alias("path"))


def widest_paths(edges: DataFrame, starts: DataFrame, max_steps: int = 1000) -> DataFrame:
    """edges (scenario, u, v, cap), both ways; starts (scenario, src) to (scenario, src, dst, width): the greatest
    capacity that every road of some route has.  Relaxed until nothing widens; the bound ``max_steps`` fails
    loudly.  [inferred semantics]"""
    roads = cut(edges.select("scenario", "u", "v", "cap").unionByName(edges.select("scenario", F.col("v").alias("u"), F.col("u").alias("v"), "cap")).groupBy("scenario", "u", "v").agg(F.max("cap").alias("cap")))
    best = starts.select("scenario", "src", F.col("src").alias("dst"), F.lit(2**31 - 1).alias("width"))
    seen = None
    for _ in range(max_steps):
        wider = best.withColumnRenamed("dst", "u").join(roads, ["scenario", "u"]).select("scenario", "src", F.col("v").alias("dst"), F.least("width", "cap").alias("width"))
        best = cut(best.unionByName(wider).groupBy("scenario", "src", "dst").agg(F.max("width").alias("width")))
        mark = tuple(best.agg(F.count(F.lit(1)), F.sum(F.col("width").cast("long"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise ValueError(f"routes still widen after {max_steps} steps")
    return best.where("dst != src")


def trips(widths: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (scenario, src, dst, tourists): trips needed if the guide takes a seat each time; 0 for no distance, null without a route."""
    rows = queries.join(widths, ["scenario", "src", "dst"], "left")
    needed = F.ceil(F.try_divide(F.col("tourists"), F.greatest(F.col("width") - 1, F.lit(0))))
    return rows.select("scenario", "src", "dst", "tourists", "width", F.when(F.col("src") == F.col("dst"), 0).otherwise(needed).cast("long").alias("trips"))
