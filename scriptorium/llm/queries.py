"""The queries op1_ to op10_: each operator with production parameters on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, language, licenses, near_dedup, packing, quality, quotes, secrets, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(_table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(html_extract.extract(_table(spark, sf_dir, "pages")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), shingle_words=2)


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_language, op3_quotes, op4_quality, op5_licenses, op6_urls, op7_html, op8_decontaminate, op9_secrets, op10_near_dedup)
}
ORACLE_SQL = {"op6_urls": urls.SQL, "op8_decontaminate": decontaminate.SQL}
