"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, release

#: Edges that a task contracts at a time.
CHUNK = 1 << 20


def _least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that these edges lead to), for nodes that aren't their own."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = label != np.arange(len(nodes))
    return nodes[some], nodes[label[some]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: edges that connect the same nodes, one a node and chunk of a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            u, v = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _least_of(u, v)], names=["u", "v"])

        for b in batches:
            held.append([b.column(i).to_numpy() for i in (0, 1)])
            n += b.num_rows
            if n >= CHUNK:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return edges.mapInArrow(run, "u long, v long").distinct()


def _to_least(edges: DataFrame, total: int, largest: int) -> DataFrame:
    """edges (u, v) and m, the least of u and all its v.  No node has more than ``largest`` edges; those with
    1/HOT_SHARE of ``total`` or more are broadcast, so that their edges never meet in one task."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    if largest * HOT_SHARE < total:
        return edges.join(least.drop("n"), "u")
    is_hot = F.col("n") * HOT_SHARE >= F.lit(total)
    marked = edges.join(F.broadcast(least.where(is_hot).drop("n")), "u", "left")
    cold = marked.where("m IS NULL").drop("m").join(least.where(~is_hot).drop("n"), "u")
    return marked.where("m IS NOT NULL").unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b), longs that aren't null; the component is its least node.

    Tasks first contract the edges that they hold.  Each round then links every node to the least of its
    neighbours (large star, then small star); stars settle at once, any graph in about log(n) rounds.
    Self-edges and repeats do no harm; no edges, no rows.
    """
    now = cut(_contracted(edges.select("a", "b").where("a != b")))
    while True:
        # Settled when every node has one edge and none leads on: each u once, and no u is a v.
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("x"))
        ends = ends.groupBy("x.node").agg(F.sum("x.out").alias("out"), F.count(F.lit(1)).alias("n"))
        total, largest, loose = ends.agg(F.sum("n"), F.max("n"), F.max((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("n") > 1)))).first()
        if not loose:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_to_least(both, total, largest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        joined = _to_least(large, total // 2, largest)
        now = cut(joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct())
        release(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
