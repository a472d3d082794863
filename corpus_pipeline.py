"""A training corpus from the documents: five stages, each written and read again by the next.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir). All but the last return the columns of the
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, language, near_dedup, packing, secrets
from scriptorium.llm._shared import Scratch, fresh_name, quoted


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: without a letter, or less familiar than its threshold for their length.

    Null and empty texts go, since they have no letter; the length of a text does not matter. Equal texts are judged alike,
    repeated rows one by one; nothing to learn from rejects all, and an empty table stays empty. No column is added on
    the way, so none can clash.
    """
    return language.accepted(docs, language.fit(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more.

    The smallest identifier of a group stays. Rows that share an identifier are one document and stay or go together; of
    rows equal in identifier and text the one whose columns come first as JSON stays. Documents without an identifier
    cannot be named, so they stay; so do null and empty texts, which are like no other. Texts are compared whole. An empty
    table stays empty. Names of added columns are chosen beside those of the documents. Only identifiers that go or that
    several rows share are looked up, by a broadcast while they are few, so that the texts stay where they are read.
    """
    row, stays = fresh_name(docs, "row"), fresh_name(docs, "stays")
    found = near_dedup.near_dedup(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    told = Scratch(spark, "deduplicate").keep(found.where("not kept or times > 1").select(F.col("doc_id").alias(row), F.col("kept").alias(stays)))
    few = told.count() <= near_dedup.BROADCAST_IDS
    named, same = docs.where("doc_id is not null"), F.col("doc_id") == F.col(row)
    chosen = lambda ids, how: named.join(F.broadcast(ids) if few else ids, same, how)
    whole = F.struct(*(F.col(quoted(c)) for c in docs.columns))
    again = chosen(told.where(stays), "left_semi")
    one = again.groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(F.col(row).alias("row")).select("row.*")
    return chosen(told, "left_anti").unionAll(one).unionAll(docs.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go.

    Null and empty texts have no words and stay; whole texts are searched, whatever their length. Repeated rows are judged
    one by one and alike; an empty table or benchmark drops nothing. All columns pass as they are.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text, and ``n_chars`` follows where there is such a column.

    All rows stay. Null and empty texts stay as they are; whole texts are scanned; overlapping spans become one mark, and
    equal texts are treated alike. An empty table stays empty. Other columns pass as they are.
    """
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: pieces with their ids.

    A null or empty text is its end id alone; a very long one is cut over as many sequences as it takes. Repeated rows are
    packed each on their own, ties in the order of arrival; an empty table gives no row. Only identifier and text are read.
    """
    return packing.pack(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", deduplicate),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: No stage but the decontamination can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
