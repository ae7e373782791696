"""Streaming forms: ticks by event time, and a light's queue as custom state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticks(events: DataFrame, ts: str = "ts", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, n): events of each window; works on streams, where the watermark closes windows, and on tables."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def queue_lengths(changes: DataFrame) -> DataFrame:
    """changes (scenario, seq, delta), streaming, to (scenario, length): a queue's length after each batch, held as state.

    Changes take effect in the order of seq, and none makes a length negative.  So the result doesn't depend on how the
    stream is cut into batches, as long as these come in that order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        length = state.get[0] if state.exists else 0
        changes = pd.concat(frames).sort_values("seq", kind="stable")
        sums = length + changes["delta"].cumsum()
        length = int(sums.iloc[-1] - min(0, sums.min()))
        state.update((length,))
        yield pd.DataFrame({"scenario": [key[0]], "length": [length]})

    return changes.groupBy("scenario").applyInPandasWithState(step, "scenario int, length long", "length long", "update", "NoTimeout")
