"""A training corpus from raw documents: five stages, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm.common import attach, cut_with, delete, release, shared_dir, sizes, table
from loamspark.llm.jaccard_groups import one_of_each
from loamspark.llm.line_dedup import line_dedup
from loamspark.llm.mixing import mix
from loamspark.llm.quality_rff import quality_filter
from loamspark.llm.queries import bpe_digests, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labels of sf_dir.

    Each row is judged by its own text: repeats and null ids stay or go alike, null counts as the empty
    text, texts of any length count whole.  Without labels all stay.  Empty in, empty out.
    """
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that begin earlier elsewhere, short ones too; n_chars follows the text.

    Null texts stay null, others may end up empty.  Rows repeated with id and text are one document and
    all keep its lines; a null id is the smallest.  Empty in, empty out.
    """
    lines = line_dedup(docs, carry=("lang", "source", "n_chars"), short_copies=True)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return lines.withColumn("n_chars", n_chars).select("doc_id", "text", "lang", "source", "n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8: the smallest id.

    Rows without words (null, empty) all stay, as nothing links them.  Rows are told apart by id and text:
    a clean row stays though another under its id, or another without id, is a copy.  Of equal rows one
    stays.  Empty in, empty out.
    """
    return one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number of times.

    Rows repeated with id and text share what the mix takes of them, and come out alike.  Rows without
    words (null, empty) go, as the mix takes nothing of them.  Empty in, empty out.
    """
    taken = mix(docs, text_hash=True).where("taken > 0").groupBy("doc_id", "text_hash").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"), F.count(F.lit(1)).alias("_n"))
    times = F.round(F.col("t") / F.col("s")).cast("int")
    # Null ids don't join: a key of an id and whether it is null does.
    taken, facts = cut_with(taken.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("text_hash").alias("_hash"), times.alias("_times"), "_n"), **sizes("_n"))
    release(spark)
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull(), "_hash": F.xxhash64("text")})
    copies = attach(keyed, taken, ["_id", "_null", "_hash"], "_n", facts, "inner").where("_times > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of the ids and of what they decode to.

    One row a row, repeats and null ids included; null and empty texts have no ids.  Empty in, empty out.
    """
    import public_tokenizers

    return bpe_digests(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("ids",))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Neither the classifier nor BPE can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Each stage's table is deleted when the next one's has been written; the one that the
    result reads stays in the folder of ``spark.checkpoint.dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
