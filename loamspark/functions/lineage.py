"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset a folder of our own will do, but only if the
    master is this machine: elsewhere executors wouldn't see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
