"""Wait statistics over state-change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wait_stats(events: DataFrame, tie: str | None = None) -> DataFrame:
    """events (id, ts, state) to (id, meals, wait_us): times from hungry to the eating that follows.

    At equal times the column ``tie`` decides, or else hungry comes before eating.
    """
    order = Window.partitionBy("id").orderBy("ts", tie or F.desc("state"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where(F.col("state").isin("hungry", "eating")).select("id", "state", micros.alias("at"), F.lag("state").over(order).alias("before"), F.lag(micros).over(order).alias("since"))
    eats = F.col("state") == "eating"
    return rows.groupBy("id").agg(F.count_if(eats).alias("meals"), F.coalesce(F.sum(F.when(eats & (F.col("before") == "hungry"), F.col("at") - F.col("since"))), F.lit(0)).alias("wait_us"))


def gaps(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """(key, n, total_gap_us, max_gap_us) between a key's events in order of time."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(Window.partitionBy(key).orderBy(ts, tie))
    return events.select(key, gap.alias("gap")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("gap"), F.lit(0)).alias("total_gap_us"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_us"))
