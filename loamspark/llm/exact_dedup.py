"""Exact dedup: a 128-bit content hash makes groups, bytes are compared within them, one row stays.

Three steps, DataFrame functions only:

1. one narrow row per document (id, hash, digest), cut; counts per hash, combined before the shuffle;
2. only texts whose hash occurs twice or more (found through a bounded bitmap) are read again and
   grouped by hash *and* text, which compares their bytes: two texts with one hash part here;
3. rows get their class's keeper; classes with a large share of the rows are broadcast, at most 256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bit_filter, cut, lower_ascii, pick, whole


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z.  ``keep`` says which id of equal texts
    stays, "smallest" or "largest".  Null texts equal empty ones.  Of ids, null is the smallest.
    Rows repeated under one id share their verdict and count in group_size.  Empty in, empty out.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    texts = pick(docs, id=id_col, text=text_col).select("id", lower_ascii(whole()).alias("text"))
    hashed = F.unhex(F.md5("text"))
    # Nulls take part in min and max only when boxed: an array orders null first.
    boxed = F.array("id")
    rows = cut(texts.select("id", hashed.alias("h"), F.unhex(F.sha2("text", 256)).alias("sha")))
    doubled = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.xxhash64("h").alias("k"))
    doubled = cut(doubled)
    n_doubled = doubled.count()
    again = bit_filter(texts.withColumn("h", hashed), F.xxhash64("h"), doubled, n_doubled)
    classes = again.groupBy("h", "text").agg(F.count(F.lit(1)).alias("group_size"), best(boxed)[0].alias("keep_id"))
    classes = cut(classes.where("group_size > 1").select("h", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size", "keep_id"))
    return attach(rows, classes, ["h", "sha"], "group_size").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
