"""Text and picture forms of results; tables stay the real results."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_labels(labelled: DataFrame, path: str) -> None:
    """One cluster number a line, in order of id."""
    labelled.orderBy("id").select(F.col("cluster").cast("string").alias("value")).write.text(path)


def write_points(points: DataFrame, path: str) -> None:
    """"N D", then a point a line in order of id, in one file as the format has it; for tables that fit a task."""
    size = points.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d"))
    head = size.select(F.lit(None).cast("long").alias("id"), F.concat_ws(" ", "n", "d").alias("value"))
    head.unionByName(point_lines(points)).coalesce(1).sortWithinPartitions(F.col("id").asc_nulls_first()).select("value").write.text(path)


def state_log(events: DataFrame) -> DataFrame:
    """events (id, ts, state) to (id, ts, state, value), a log line for each change of a worker's state."""
    line = F.format_string("[%s] %s %s", F.col("id").cast("string"), F.col("ts").cast("string"), "state")
    return events.select("id", "ts", "state", line.alias("value"))


def point_lines(points: DataFrame) -> DataFrame:
    return points.select("id", F.array_join(F.transform("x", lambda v: v.cast("string")), " ").alias("value"))


def report_lines(report: DataFrame) -> DataFrame:
    line = F.format_string("average length %s, longest %s, average wait %s s, longest %s s", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("avg_len", "max_len", "avg_wait_s", "max_wait_s")])
    return report.select("scenario", line.alias("value"))


def tour_lines(tours: DataFrame) -> DataFrame:
    return tours.select("case_id", F.format_string("%d: %s", "cost", F.array_join("path", " - ")).alias("value"))


def bitmap(segments: DataFrame, width: int = 640, height: int = 512) -> bytes:
    """A 32-bit BMP of the segments, white on black; a picture's segments fit the driver."""
    pixels = bytearray(4 * width * height)
    for r in segments.select("x0", "y0", "x1", "y1").collect():
        steps = max(abs(r["x1"] - r["x0"]), abs(r["y1"] - r["y0"]), 1)
        for i in range(steps + 1):
            x, y = (round(r[a] + (r[b] - r[a]) * i / steps) for a, b in (("x0", "x1"), ("y0", "y1")))
            if 0 <= x < width and 0 <= y < height:
                at = 4 * ((height - 1 - y) * width + x)
                pixels[at : at + 4] = b"\xff\xff\xff\x00"
    head = struct.pack("<2sIHHI", b"BM", 54 + len(pixels), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 32, 0, len(pixels), 0, 0, 0, 0) + bytes(pixels)
