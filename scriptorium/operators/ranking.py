"""Scoring of postings and stable top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import index as ix

MODES = ("bm25", "tf", "match")
#: Digits to which scores are compared, so that equal documents tie whatever the order of a sum.
DIGITS = 9


#: Contributions are summed as whole multiples of this, so that a sum does not depend on the order of its parts.
UNIT = 1e-13


def contribution(mode: str) -> Column:
    """Of one query term to one document, from tf, norm and idf."""
    if mode == "bm25":
        return F.col("idf") * F.lit(ix.K1 + 1) * F.col("tf") / (F.col("tf") + F.col("norm"))
    if mode == "tf":
        return F.col("tf")
    if mode == "match":
        return F.lit(1)
    raise ValueError(f"unknown scoring mode: {mode}")


def total_score(mode: str) -> Column:
    """The sum of the contributions, the same whatever the order: it is combined map-side as whole numbers.

    A contribution to BM25 is at most 2.2 times an idf, so a query would need tens of thousands of distinct terms to pass 64 bits.
    """
    if mode == "bm25":
        return F.round(F.sum(F.round(contribution(mode) / F.lit(UNIT)).cast("long")) * F.lit(UNIT), DIGITS)
    return F.sum(contribution(mode)).cast("double")


def scores(posted: DataFrame, terms: DataFrame, stats: DataFrame, query: list[str], mode: str = "bm25") -> DataFrame:
    """id, category and score of every document that holds a query term; repeated query terms count once.

    posted: term, id, tf. terms: term, idf. stats: id, category, norm.
    """
    wanted = posted.where(F.col("term").isin(*set(query))) if query else posted.limit(0)
    joined = wanted.join(F.broadcast(terms.where(F.col("term").isin(*set(query))) if query else terms.limit(0)), "term").join(stats, "id")
    return joined.groupBy("id", "category").agg(total_score(mode).alias("score"))


def stored_scores(posted: DataFrame, terms: DataFrame, query: list[str], mode: str = "bm25") -> DataFrame:
    """``scores`` on stored postings that hold category and norm themselves: only the query's few terms are joined."""
    if not query:
        return posted.limit(0).groupBy("id", "category").agg(F.lit(0.0).alias("score"))
    wanted = F.col("term").isin(*set(query))
    return posted.where(wanted).join(F.broadcast(terms.where(wanted).select("term", "idf")), "term").groupBy("id", "category").agg(total_score(mode).alias("score"))


def rank(scored: DataFrame, category: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """The page of the ranking: score descending, id ascending. Idf stays that of the whole collection."""
    kept = scored.where(F.col("category") == category) if category else scored
    return kept.orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def total(scored: DataFrame, category: str | None = None) -> DataFrame:
    """The number of matches, whatever the page."""
    return (scored.where(F.col("category") == category) if category else scored).agg(F.count("*").alias("total"))
