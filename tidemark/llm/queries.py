"""The thin queries opN_* over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, preference, quality, sql, toxicity
from .common import fold, table
from .decontaminate import contained
from .langid import identify
from .mixing import mix
from .ngram_join import ngram_join
from .secrets import secret_report
from .topk import exact_topk


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), budget_share=1.0, target_entropy=0.97)


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.turns_of(table(spark, sf_dir, "conversations"))
    out = preference.paired(turns, preference.by_opening(turns))
    masks = {c: preference.spans_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")}
    return out.withColumns(masks)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    found = quality.score(table(spark, sf_dir, "documents"), labels.filter("label = 1"))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    found = toxicity.score(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, num=80, den=100)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fold("doc_id", 3) != 1)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_source_mixing": op2_source_mixing,
    "op3_preference_format": op3_preference_format,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
}

SQL: dict[str, str] = {
    "op1_exact_topk": sql.OP1,
    "op2_source_mixing": sql.OP2,
    "op3_preference_format": sql.OP3,
    "op4_line_dedup": sql.OP4,
    "op6_ngram_jaccard_join": sql.OP6,
    "op8_decontamination": sql.OP8,
    "op9_secret_scan": sql.OP9,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
