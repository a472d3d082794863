"""Inverted index as DataFrames: analysis, postings, collection statistics, vocabulary and phrases.

A corpus is a DataFrame with id, title, abstract and category. The analysis is one projection; every table below is one
aggregate over it with a map-side combine, so the only shuffles are those on (term, id), on word and on phrase. ``analysis``
holds all that an index needs of a document, so that a build reads and analyses every text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, MAX_TF = 1.2, 0.75, 65_535


def from_documents(documents: DataFrame) -> DataFrame:
    """The corpus view of a table with one text per row: the first line is the title, the rest the abstract."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return documents.select(F.col("doc_id").alias("id"), title.alias("title"), F.substring("text", F.length(title) + 1, F.length("text")).alias("abstract"), F.col("source").alias("category"))


def analysed(corpus: DataFrame, title_boost: int = T.TITLE_BOOST) -> DataFrame:
    """id, category, the terms of both fields, and the weighted length."""
    title = T.terms(F.col("title")) if title_boost else F.array().cast("array<string>")
    out = corpus.select("id", "category", title.alias("title_terms"), T.terms(F.col("abstract")).alias("abstract_terms"))
    return out.withColumn("doc_len", (F.size("abstract_terms") + title_boost * F.size("title_terms")).cast("long"))


def analysis(corpus: DataFrame, title_boost: int = T.TITLE_BOOST) -> DataFrame:
    """``analysed``, with the distinct content words and the title's phrases."""
    spread = corpus.select("id", "category", T.words(F.col("title")).alias("title_words"), T.content_words(F.col("title")).alias("title_content"), T.content_words(F.col("abstract")).alias("abstract_content"))
    stems = lambda c: F.transform(c, T.stem)
    out = spread.select("id", "category", stems("title_content").alias("title_terms"), stems("abstract_content").alias("abstract_terms"), F.array_distinct(F.concat("title_content", "abstract_content")).alias("content"), T.title_phrases(F.col("title_words")).alias("phrases"))
    return out.withColumn("doc_len", (F.size("abstract_terms") + title_boost * F.size("title_terms")).cast("long"))


def sorted_postings(docs: DataFrame, avg_len: float, title_boost: int = T.TITLE_BOOST) -> DataFrame:
    """term, id, tf, category, norm of analysed documents in the order of (term, id), by one shuffle.

    The terms are dealt by ranges of (term, id) before they are counted: no term is too frequent for a task, and neither
    counting nor sorting deals them anew.
    """
    norms = docs.select("id", "category", norm(F.col("doc_len"), F.lit(avg_len)).alias("norm"), "title_terms", "abstract_terms")
    entry = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    terms = norms.select("id", "category", "norm", F.explode(F.concat(entry("title_terms", title_boost), entry("abstract_terms", 1))).alias("x")).select("x.term", "id", "category", "norm", "x.w")
    counted = terms.repartitionByRange("term", "id").groupBy("term", "id").agg(F.least(F.sum("w"), F.lit(MAX_TF)).cast("long").alias("tf"), F.first("category").alias("category"), F.first("norm").alias("norm"))
    return counted.sortWithinPartitions("term", "id")


def postings(docs: DataFrame, title_boost: int = T.TITLE_BOOST, only: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """term, id, tf of analysed documents; ``only`` restricts the terms before anything is shuffled.

    carry: further columns of the documents to stand with each posting.
    """
    wanted = lambda c: F.filter(c, lambda t: t.isin(*only)) if only is not None else F.col(c)
    # runs of one term in one document are counted map-side, since they are in one partition
    weighted = docs.select("id", *carry, F.explode(F.concat(F.transform(wanted("title_terms"), lambda t: F.struct(t.alias("term"), F.lit(title_boost).alias("w"))), F.transform(wanted("abstract_terms"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("w"))))).alias("x"))
    return weighted.groupBy("x.term", "id").agg(F.least(F.sum("x.w"), F.lit(MAX_TF)).cast("long").alias("tf"), *(F.first(c).alias(c) for c in carry))


def collection(docs: DataFrame) -> DataFrame:
    """One row: number of documents, average weighted length."""
    n = F.count("*")
    return docs.agg(n.alias("num_docs"), F.when(n > 0, F.sum("doc_len") / n).otherwise(0.0).alias("avg_len"))


def norm(doc_len: Column, avg_len: Column) -> Column:
    """The length norm, at single precision as it is stored."""
    divisor = F.when(avg_len == 0, F.lit(1.0)).otherwise(avg_len)
    return (F.lit(K1) * (F.lit(1 - B) + F.lit(B) * doc_len / divisor)).cast("float").cast("double")


def doc_stats(docs: DataFrame) -> DataFrame:
    """id, category, doc_len and norm of every document, those without a term included."""
    one = docs.select("id", "category", "doc_len")
    return one.crossJoin(F.broadcast(collection(docs))).select("id", "category", "doc_len", norm(F.col("doc_len"), F.col("avg_len")).alias("norm"))


def idf(num_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (num_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_stats(posted: DataFrame, coll: DataFrame) -> DataFrame:
    """term, df and idf."""
    counted = posted.groupBy("term").agg(F.count("*").alias("df"))
    return counted.crossJoin(F.broadcast(coll.select("num_docs"))).select("term", "df", idf(F.col("num_docs"), F.col("df")).alias("idf"))


def minimum_count(num_docs: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(num_docs / 20_000)).cast("long")


def _frequent(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    size = corpus.agg(F.count("*").alias("num_docs"))
    return counts.crossJoin(F.broadcast(size)).where(F.col("n") >= minimum_count(F.col("num_docs"))).drop("num_docs")


def vocabulary(corpus: DataFrame) -> DataFrame:
    """word and the number of documents that hold it, unstemmed, those that occur often enough.

    corpus: with title and abstract, or analysed, with ``content``.
    """
    words = F.col("content") if "content" in corpus.columns else F.array_distinct(F.concat(T.content_words(F.col("title")), T.content_words(F.col("abstract"))))
    counts = corpus.select(F.explode(words).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return _frequent(counts, corpus).select("key", F.col("n").alias("weight"))


def phrase_counts(corpus: DataFrame) -> DataFrame:
    """Every occurrence of a title phrase counts. corpus: with title, or analysed, with ``phrases``."""
    made = F.col("phrases") if "phrases" in corpus.columns else T.title_phrases(T.words(F.col("title")))
    return corpus.select(F.explode(made).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


def phrases(corpus: DataFrame) -> DataFrame:
    """Frequent phrases, weighted by occurrences times words."""
    frequent = _frequent(phrase_counts(corpus), corpus)
    return frequent.select(F.col("phrase").alias("key"), (F.col("n") * F.size(F.split("phrase", " "))).cast("long").alias("weight"))


def category_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("category").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "category")


def engine_stats(docs: DataFrame, posted: DataFrame, words: DataFrame, title_phrases: DataFrame) -> DataFrame:
    """One row of facts about an index."""
    coll = docs.agg(F.count("*").alias("documents"), F.round(F.coalesce(F.avg("doc_len"), F.lit(0.0)), 1).alias("average_length"), F.count_distinct("category").alias("categories"))
    terms = posted.groupBy("term").agg(F.count("*").alias("df")).agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return coll.crossJoin(terms).crossJoin(words.agg(F.count("*").alias("suggestion_words"))).crossJoin(title_phrases.agg(F.count("*").alias("suggestion_phrases")))
