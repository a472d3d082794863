"""Query correction and the composed search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexicon

#: A typo candidate must be in this many times more documents than the rare word.
RARE_WORD_FACTOR = 100


def correct_words(words: DataFrame, terms: DataFrame, vocabulary: DataFrame, rare_word_factor: int = RARE_WORD_FACTOR) -> DataFrame:
    """word and replacement (null: keep it), for content words. terms: term, df. vocabulary: key, weight.

    A word whose stem is not indexed takes the closest known word. A word that is indexed but too rare for the vocabulary
    takes a known word at one edit that is far more frequent.
    """
    known = words.select("word").distinct().withColumn("term", T.stem(F.col("word"))).join(terms.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    absent = lexicon.correct(vocabulary, known.where("df = 0")).select("word", F.col("correction").alias("replacement"))
    rare = known.where("df > 0").join(vocabulary.select(F.col("key").alias("word")), "word", "left_anti")
    near = lexicon.correct(vocabulary, rare, 1).where("correction is not null")
    heavy = near.join(rare, "word").join(vocabulary.select(F.col("key").alias("correction"), "weight"), "correction").where(F.col("weight") >= rare_word_factor * F.col("df"))
    return absent.where("replacement is not null").unionByName(heavy.select("word", F.col("correction").alias("replacement")))


def correct_queries(queries: DataFrame, terms: DataFrame, vocabulary: DataFrame, correct: bool = True, rare_word_factor: int = RARE_WORD_FACTOR) -> DataFrame:
    """qid, content (array of corrected content words) and corrected (the query's words, or null if none changed).

    queries: qid, query.
    """
    spread = queries.select("qid", F.posexplode_outer(T.words(F.col("query"))).alias("pos", "word"))
    spread = spread.withColumn("is_content", F.coalesce(T.is_content_word(F.col("word")), F.lit(False)))
    if correct:
        fixed = correct_words(spread.where("is_content").select("word"), terms, vocabulary, rare_word_factor)
        spread = spread.join(fixed, "word", "left").withColumn("replacement", F.when(F.col("is_content"), F.col("replacement")))
    else:
        spread = spread.withColumn("replacement", F.lit(None).cast("string"))
    spread = spread.withColumn("out", F.coalesce("replacement", "word"))
    # a query is one short row, so its words are bounded
    words = F.array_sort(F.collect_list(F.struct("pos", "out", "is_content")))
    made = spread.groupBy("qid").agg(words.alias("w"), F.max(F.col("replacement").isNotNull()).alias("changed"))
    return made.select("qid", F.transform(F.filter("w", lambda x: x["is_content"]), lambda x: x["out"]).alias("content"), F.when(F.col("changed"), F.array_join(F.transform("w", lambda x: x["out"]), " ")).alias("corrected"))


def query_words(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "qid int, query string")


def marked_rows(rows: DataFrame, query_terms: list[str]) -> DataFrame:
    """Result columns of documents, their titles and snippets marked."""
    return rows.select(
        "id",
        "arxiv_id",
        F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id").alias("url"),
        T.highlight(F.col("title"), query_terms).alias("title"),
        T.snippet(F.col("abstract"), query_terms)["pieces"].alias("snippet"),
        "authors",
        F.col("primary_category").alias("category"),
        "published",
    )


def result_rows(page: DataFrame, store: DataFrame, query_terms: list[str]) -> DataFrame:
    """The page's documents with marked titles and snippets; only these documents are read from the store.

    page: id, score (at most one page of rows). store: id, arxiv_id, title, abstract, authors, primary_category, published.
    """
    page = page.select("id", "score")
    rows = store.join(F.broadcast(page.select("id")), "id", "left_semi")
    return marked_rows(rows, query_terms).join(F.broadcast(page), "id").orderBy(F.desc("score"), "id")
