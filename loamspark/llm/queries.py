"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, mixing
from .bpe import bpe_encode
from .brown import lm_scores
from .common import table
from .fst_count import fst_token_counts
from .html_extract import extract_html
from .jaccard_groups import near_components
from .quality_rff import quality_scores
from .repetition import quality_rules


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), short_copies=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    coded = bpe_encode(docs, path, pattern, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_mixing, op3_line_dedup, op4_quality_rules, op5_bpe, op6_token_counts, op7_jaccard, op8_exact_dedup, op9_class_lm, op10_html)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
