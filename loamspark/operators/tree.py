"""A binary tree of line segments by a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tree_segments(spark: SparkSession, width: int = 640, height: int = 512, trunk: float = 130.0, scale: float = 0.75, turn: float = 24.0, least: float = 2.0) -> DataFrame:
    """(level, branch, x0, y0, x1, y1): the trunk, level 0, then two branches at each end while they are long enough.

    A branch is a vector as long as its size, cut to a whole number, turned from straight up by its angle; its
    coordinates are cut toward zero (past the ninth decimal nothing counts) and added to where it starts.
    """
    return spark.sql(f"""
WITH RECURSIVE t(level, branch, x0, y0, x1, y1, angle, size) MAX RECURSION LEVEL 200 AS (
  SELECT 0, CAST(0 AS BIGINT), {width // 2}, {height - 1}, {width // 2}, {height - 1 - int(trunk)}, CAST(0 AS DOUBLE), CAST({trunk} AS DOUBLE)
  UNION ALL
  SELECT level + 1, branch * 2 + b, x1, y1,
         x1 + CAST(round(-CAST(size * {scale} AS INT) * sin(radians(angle + (1 - 2 * b) * {turn})), 9) AS INT), y1 - CAST(round(CAST(size * {scale} AS INT) * cos(radians(angle + (1 - 2 * b) * {turn})), 9) AS INT),
         angle + (1 - 2 * b) * {turn}, size * {scale}
  FROM t LATERAL VIEW explode(array(0, 1)) AS b WHERE size * {scale} >= {least})
SELECT level, branch, x0, y0, x1, y1 FROM t""")
