"""Helpers shared by the text operators.

Conventions for every operator:

* Input columns are found by their exact name; all other columns, also those whose names clash with
  names used here or differ only in case, are left out before any work begins.
* A null text counts as the empty text.  A null id is an id like any other.
"""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_dir

#: A word is a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group with at least this share of all rows is "hot"; there are at most HOT_SHARE of them.
HOT_SHARE = 256
#: Average bytes on disk of a checkpoint's partitions below which they are merged, and those of a task that reads them then.
SMALL, MERGED = 1 << 18, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """``pick(df, doc_id="id")`` has df's column ``id`` as ``doc_id``; chosen by exact name and place."""
    have = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{have.index(old)}").alias(new) for new, old in names.items()])


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a checkpoint in the folder of ``spark.checkpoint.dir``; see :func:`shared_dir`.

    Partitions of less than SMALL bytes on average are read together, about MERGED bytes in a task, so that small
    tables don't take a task for each.  What a shuffle deals out by key stays as it is.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    trim(df.sparkSession)
    rdd = out._jdf.queryExecution().analyzed().rdd()
    parts, least = rdd.getNumPartitions(), 2 * df.sparkSession.sparkContext.defaultParallelism
    if parts > 2 * least:
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        size = place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
        most = max(least, math.ceil(size / MERGED))
        if size < SMALL * parts and parts > 2 * most:
            return out.coalesce(most)
    return out


def cut_with(df: DataFrame, **facts: Column) -> tuple[DataFrame, dict]:
    """cut(df), and aggregates over its rows from the same pass.  A task that runs twice may count twice, so
    they are fit for sizes and shares only."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in facts.items()]))
    return out, {k: v or 0 for k, v in seen.get.items()}


def release(spark: SparkSession) -> None:
    """Between an operator's phases: shuffles, broadcasts and checkpoints no longer in use are deleted
    when the driver collects its garbage, which on its own it may do late; its heap shrinks, too, and so do the executors'."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)
    shrink(spark)


def shrink(spark: SparkSession) -> int:
    """Executors collect their garbage, and so hand back to the system the heap that a phase needed and the next one
    doesn't; their number.  A task for each, which idle executors are dealt one by one.  Where the driver is the
    executor there is nothing more to do."""
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    if executors:
        spark.range(0, executors, 1, executors).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
    return executors


def trim(spark: SparkSession) -> bool:
    """Hands back to the system what the driver's JVM has freed outside its heap; false where it has no such command.

    Compiling a plan's code takes much memory there, which the C library keeps, in dozens of pools, once it is freed.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        args = new(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = new(jvm.Object, 0), new(jvm.String, 0)
        # The server's own class is closed to reflection, its interface is not.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(server, args)
    except Py4JError:
        return False
    return True


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """df as a table in the checkpoints' folder, more compact than a checkpoint; deleted at the end, so
    what is made of it must have been cut by then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete(spark, path)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; at a task's end the worker hands back to the system what the task has freed.

    Else the C library and Arrow keep it while the worker is idle, and others work.
    """

    def whole_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
        if give_back:
            give_back(0)

    return whole_task


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with ``most`` bytes of text, or items of lists, or one row, so that a worker's memory
    doesn't follow Spark's batch size.  ``text``: number of the column that holds them."""
    for b in batches:
        column = b.column(text)
        length = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        part = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for start, end in zip(starts, starts[1:]):
            if end > start:
                yield b.slice(start, end - start)


def sizes(size: str) -> dict[str, Column]:
    return {"total": F.sum(size), "largest": F.max(size)}


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, facts: dict | None = None, how: str = "left") -> DataFrame:
    """Join of rows to their group's row, safe for groups of any size.

    ``size`` is the group's number of rows.  Groups with 1/HOT_SHARE of all these rows or more number
    HOT_SHARE at most, so they may be broadcast and their rows never meet in one task; all other groups
    are small enough to be dealt out by key.  Both inputs are read twice and should be cheap to read.
    ``facts``: :func:`sizes` of the groups, if :func:`cut_with` has gathered them.
    """
    facts = facts or groups.agg(*[c.alias(k) for k, c in sizes(size).items()]).first().asDict()
    total, largest = facts["total"], facts["largest"]
    if not total or largest * HOT_SHARE < total:
        return rows.join(groups, keys, how)
    is_hot = F.col(size) * HOT_SHARE >= F.lit(total)
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    marked = rows.join(F.broadcast(hot), keys, "left")
    rest = marked.where(F.col(size).isNull()).select(*rows.columns).join(cold, keys, how)
    return marked.where(F.col(size).isNotNull()).unionByName(rest)


def _flagged(rows: DataFrame, key: Column, keys: DataFrame, n_keys: int) -> DataFrame:
    """rows and ``_maybe``: whether key (a hash, long) may be among ``keys``' column ``k``; true if it is.

    A one-hash bitmap with about 16 bits a key, from 4 KB to 32 MB: beyond 2**28 bits it lets more
    rows through, and stays as large.  The bitmap is a broadcast table of 4 KB rows.
    """
    bits = min(28, max(15, math.ceil(math.log2(16 * max(1, n_keys)))))
    spot = lambda k: F.pmod(k, F.lit(1 << bits))
    bucket = lambda k: F.shiftright(spot(k), 15).cast("int")
    position = lambda k: spot(k).bitwiseAND(F.lit(32767))
    maps = keys.groupBy(bucket(F.col("k")).alias("_bucket")).agg(F.bitmap_construct_agg(position(F.col("k"))).alias("_bits"))
    octet = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(position(key), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", octet, position(key).bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    joined = rows.withColumn("_bucket", bucket(key)).join(F.broadcast(maps), "_bucket", "left")
    return joined.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_bucket", "_bits")


def bit_filter(rows: DataFrame, key: Column, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows whose key may be among ``keys``; none that is there is lost."""
    return _flagged(rows, key, keys, n_keys).where("_maybe").drop("_maybe")


def bit_split(rows: DataFrame, key: Column, keys: DataFrame, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose key isn't among ``keys``, as a bitmap can tell, and the rest; rows are read once for each."""
    flagged = _flagged(rows, key, keys, n_keys)
    return flagged.where(~F.col("_maybe")).drop("_maybe"), flagged.where("_maybe").drop("_maybe")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What the rows repeated under one id with one text have in common, and no others."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))


def drop_keys(rows: DataFrame, key: Column, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows whose key isn't among ``keys``, a table of that one column without repeats, cut; only rows that a
    bitmap can't clear are shuffled."""
    bad = keys.toDF("_bad")
    flagged = _flagged(rows, F.xxhash64(key), bad.select(F.xxhash64("_bad").alias("k")), n_keys)
    clear = flagged.where(~F.col("_maybe"))
    rest = flagged.where("_maybe").withColumn("_key", key).join(bad, F.col("_key").eqNullSafe(F.col("_bad")), "left_anti")
    return clear.select(*rows.columns).unionByName(rest.select(*rows.columns))
