"""The queries of these operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, html, language, neardup, quality, secrets, sentencepiece, tokencount, toxicity
from .common import folder


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.Ledger(spark, folder(spark, "ledger")).scan(_read(spark, sf_dir, "documents"))


def sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)


def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")), drop_text=True)


def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.detect(docs.select("doc_id", "text"), language.train(docs), drop_text=True)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(_read(spark, sf_dir, "documents").select("doc_id", "text")).pairs()


def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(_read(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "html")
    return html.extract(pages, html.train(pages), drop_html=True)


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.build(docs, _read(spark, sf_dir, "labels")), drop_text=True)


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_read(spark, sf_dir, "embeddings"), where="vec_id % 50 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan,
    "op2_sentencepiece": sentencepiece_ids,
    "op3_quality": quality_grades,
    "op4_language_mixture": language_mixture,
    "op5_near_duplicates": near_duplicates,
    "op6_decontamination": benchmark_matches,
    "op7_html_extraction": main_text,
    "op8_toxicity": toxic_documents,
    "op9_nearest_neighbours": nearest_vectors,
    "op10_token_counts": token_counts,
}

ORACLE: dict[str, str] = {"op1_secret_scan": secrets.scan_sql()}
