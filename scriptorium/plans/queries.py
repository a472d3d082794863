"""The registered queries: every operator on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, lexicon, query, ranking
from ..operators import index as ix
from ..operators.suggest import suggest
from ..session import scratch_path, spread
from ..sources import records, store
from .engine import SearchEngine

QUERY = "the thing and anonly erthat of tionth"
TERMS = ["thing", "anonly", "erthat", "tionth"]
TYPOS = "the thign and anonyl of erhtat ofth"
WORDS = ("thign", "anonyl", "erhtat", "tionht", "thing", "ofth", "zzzzzzzz", "th")
CATEGORY = "src3"
#: Titles that the sampled evaluation asks for.
SAMPLE = 50
PAIRS = (("neural", "nueral"), ("ca", "abc"), ("graph", "graph"), ("kitten", "sitting"), ("ab", "ba"), ("search", "serch"), ("index", "vortex"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents of few splits are dealt over the cores by id, since a text is much work for its size."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, "doc_id") if name == "documents" else rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.from_documents(_read(spark, sf_dir, "documents"))


def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a harvester delivers them; identifiers of both styles are made from doc_id."""
    docs = _read(spark, sf_dir, "documents")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    number = F.lpad((F.col("doc_id") % 100_000).cast("string"), 5, "0")
    yymm = F.concat(F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"))
    identifier = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("cs/"), yymm, F.substring(number, 3, 3))).when(F.col("doc_id") % 3 == 1, F.concat(yymm, F.lit("."), number)).otherwise(F.concat(F.lit("x"), number))
    return docs.select("doc_id", identifier.alias("id"), title.alias("title"), F.substring("text", F.length(title) + 1, F.length("text")).alias("abstract"), F.concat("source", F.lit("  writer")).alias("authors"), F.concat("source", F.lit(" "), "lang").alias("categories"))


# --- analysis


def tokens_words(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word")).select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


def tokens_terms(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.terms(F.col("text"))).alias("pos", "term")).select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


def stem_vocab(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).distinct().select("word", T.stem(F.col("word")).alias("stem"), T.is_content_word(F.col("word")).alias("is_content"))


def normalise_docs(spark, sf_dir):
    return records.normalise(paper_records(spark, sf_dir))


def published_month(spark, sf_dir):
    return paper_records(spark, sf_dir).select("doc_id", "id", T.published_month(F.col("id")).alias("published"))


def ingest_dedup(spark, sf_dir):
    """One source is stored already; of all records those are added that it does not hold, one per identifier."""
    all_records = paper_records(spark, sf_dir)
    old = records.normalise(all_records.where("startswith(categories, 'src0 ')"))
    new = store.new_records(all_records, old, F.col("doc_id"))
    return new.select("id", "doc_id", "title")


# --- store


def _store(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return docs.select(F.col("doc_id").alias("id"), title.alias("title"), F.substring("text", F.length(title) + 1, F.length("text")).alias("abstract"))


def store_count(spark, sf_dir):
    return _store(spark, sf_dir).agg(F.count("*").alias("n"))


def get_documents(spark, sf_dir):
    return store.by_ids(_store(spark, sf_dir), [3, 17, 42, 99])


def keyset_page(spark, sf_dir):
    return store.page(_store(spark, sf_dir).select("id", "title"), 20, 25)


def naive_search(spark, sf_dir):
    return store.naive_search(_store(spark, sf_dir), ["thing", "anon"], 10)


# --- index


def postings(spark, sf_dir):
    return ix.postings(ix.analysed(corpus(spark, sf_dir)))


def doc_norm(spark, sf_dir):
    return ix.doc_stats(ix.analysed(corpus(spark, sf_dir))).select("id", "category", "doc_len", F.round("norm", 6).alias("norm"))


def term_idf(spark, sf_dir):
    docs = ix.analysed(corpus(spark, sf_dir))
    return ix.term_stats(ix.postings(docs), ix.collection(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


def vocabulary(spark, sf_dir):
    return ix.vocabulary(corpus(spark, sf_dir))


def title_phrases(spark, sf_dir):
    return ix.phrase_counts(corpus(spark, sf_dir))


def phrase_weights(spark, sf_dir):
    return ix.phrases(corpus(spark, sf_dir))


def category_counts(spark, sf_dir):
    return ix.category_counts(corpus(spark, sf_dir))


def engine_stats(spark, sf_dir):
    c = corpus(spark, sf_dir)
    docs = ix.analysed(c)
    return ix.engine_stats(docs, ix.postings(docs), ix.vocabulary(c), ix.phrases(c))


# --- ranking


def _scores(spark, sf_dir, mode="bm25", terms=TERMS):
    """Scores on the raw table: one analysis, of which only lengths and the query's terms are kept."""
    docs, path = ix.analysed(corpus(spark, sf_dir)), scratch_path(spark, "matched")
    among = lambda c: F.filter(c, lambda t: t.isin(*terms)).alias(c)
    docs.select("id", "category", "doc_len", among("title_terms"), among("abstract_terms")).write.parquet(path)
    docs = spark.read.parquet(path)
    coll = ix.collection(docs)
    posted = ix.postings(docs, carry=("category", "doc_len"))
    normed = posted.crossJoin(F.broadcast(coll)).withColumn("norm", ix.norm(F.col("doc_len"), F.col("avg_len")))
    return ranking.stored_scores(normed, ix.term_stats(posted, coll), terms, mode)


def _rounded(df):
    return df.select("id", "category", F.round("score", 6).alias("score"))


def score_bm25(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir))


def score_tf(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir, "tf"))


def score_match(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir, "match"))


def rank_bm25_topk(spark, sf_dir):
    return _rounded(ranking.rank(_scores(spark, sf_dir)))


def rank_category(spark, sf_dir):
    return _rounded(ranking.rank(_scores(spark, sf_dir), CATEGORY))


def rank_page(spark, sf_dir):
    return _rounded(ranking.rank(_scores(spark, sf_dir), limit=10, offset=20))


def match_total(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return ranking.total(s).select(F.lit("").alias("category"), "total").unionAll(ranking.total(s, CATEGORY).select(F.lit(CATEGORY).alias("category"), "total"))


# --- completion, spelling


def complete_words(spark, sf_dir):
    return lexicon.complete(vocabulary(spark, sf_dir), "th")


def complete_phrases(spark, sf_dir):
    return lexicon.complete(phrase_weights(spark, sf_dir), "th")


def _suggestions(spark, sf_dir, text):
    found = suggest(text, vocabulary(spark, sf_dir), phrase_weights(spark, sf_dir))
    return spark.createDataFrame([(i, s) for i, s in enumerate(found)], "pos long, suggestion string")


def suggest_single(spark, sf_dir):
    return _suggestions(spark, sf_dir, "Th")


def suggest_multi(spark, sf_dir):
    return _suggestions(spark, sf_dir, "zebra th")


def edit_distance(spark, sf_dir):
    """Of all content words of the benchmark's texts to a literal, and of some pairs that tell the distances apart."""
    words = _read(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(T.content_words(F.col("text")))).alias("a")).distinct().select("a", F.lit("thing").alias("b"))
    pairs = spark.createDataFrame(PAIRS, "a string, b string")
    return words.unionAll(pairs).select("a", "b", T.edit_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


def _words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


def fuzzy_candidates(spark, sf_dir):
    return lexicon.fuzzy(vocabulary(spark, sf_dir), _words(spark), 2).select("word", "key", F.col("distance").cast("long").alias("distance"), "weight")


def spell_correct(spark, sf_dir):
    return lexicon.correct(vocabulary(spark, sf_dir), _words(spark))


def correct_query(spark, sf_dir):
    c = corpus(spark, sf_dir)
    docs = ix.analysed(c)
    terms = ix.term_stats(ix.postings(docs), ix.collection(docs))
    out = query.correct_queries(query.query_words(spark, TYPOS), terms, ix.vocabulary(c), rare_word_factor=2)
    return out.select(F.array_join("content", " ").alias("content"), "corrected")


# --- snippets


def highlight_title(spark, sf_dir):
    pieces = T.highlight(F.col("title"), TERMS)
    return corpus(spark, sf_dir).select("id", F.posexplode(pieces).alias("pos", "p")).select("id", F.col("pos").cast("long").alias("pos"), "p.text", "p.hit")


def best_snippet(spark, sf_dir):
    s = corpus(spark, sf_dir).select("id", T.snippet(F.col("abstract"), TERMS).alias("s"))
    return s.select("id", F.col("s.start").cast("long").alias("start"), F.col("s.hits").cast("long").alias("hits"), F.array_join(F.transform("s.pieces", lambda p: p["text"]), "").alias("snippet"))


def search(spark, sf_dir):
    """The composed search: ranking first, then only the page's documents are marked."""
    page = ranking.rank(_scores(spark, sf_dir))
    rows = paper_records(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("id").alias("arxiv_id"), "title", "abstract", "authors", F.split_part("categories", F.lit(" "), F.lit(1)).alias("primary_category"), T.published_month(F.col("id")).alias("published"))
    found = query.result_rows(page, rows, TERMS)
    text = lambda c: F.array_join(F.transform(c, lambda p: F.when(p["hit"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"])), "")
    return found.select("id", "arxiv_id", "url", text("title").alias("title"), text("snippet").alias("snippet"), "authors", "category", "published", F.round("score", 6).alias("score"))


def stored_search(spark, sf_dir):
    """The same search on an index that is built, saved and loaded again."""
    store_path, index_path = scratch_path(spark, "store"), scratch_path(spark, "index")
    rows = paper_records(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("id").alias("arxiv_id"), "title", "abstract", "authors", "categories", F.split_part("categories", F.lit(" "), F.lit(1)).alias("primary_category"), T.published_month(F.col("id")).alias("published"))
    store.write_sorted(rows, store_path)
    stored = spark.read.schema(store.SCHEMA).parquet(store_path)
    SearchEngine.build(spark, stored).save(index_path)
    engine = SearchEngine.load(spark, index_path, stored)
    _, terms, total, page = engine.matches(QUERY, correct=False)
    text = lambda pieces: "".join(f"[{p['text']}]" if p["hit"] else p["text"] for p in pieces)
    found = [(i, r["arxiv_id"], r["url"], text(r["title"]), text(r["snippet"]), r["authors"], r["category"], r["published"], round(score, 6), total) for (i, score), r in zip(page, engine.result_rows(page, terms), strict=True)]
    return spark.createDataFrame(found, "id long, arxiv_id string, url string, title string, snippet string, authors string, category string, published string, score double, total long")


# --- sources and the store


def jsonl_source(spark, sf_dir):
    """The records written as JSON lines and read again."""
    path = scratch_path(spark, "jsonl")
    records.write_jsonl(paper_records(spark, sf_dir).drop("doc_id"), path)
    return records.read_jsonl(spark, path)


def oai_source(spark, sf_dir):
    """Records in the words of the documents as harvested XML, every tenth deleted, read again."""
    path = scratch_path(spark, "oai")
    plain = lambda c: F.array_join(T.words(F.col(c)), "\n  ")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    names = F.concat(tag("author", F.concat(tag("keyname", F.split_part("authors", F.lit(" "), F.lit(1))), tag("forenames", F.lit("A. B.")))), tag("author", tag("keyname", F.lit("Writer"))))
    fields = F.concat(tag("id", F.col("id")), tag("authors", names), tag("title", plain("title")), tag("categories", F.col("categories")), tag("abstract", plain("abstract")))
    body = F.when(F.col("doc_id") % 10 == 0, F.lit('<header status="deleted"><identifier>x</identifier></header>')).otherwise(F.concat(F.lit("<header><identifier>y</identifier></header>"), tag("metadata", tag("arXiv", fields))))
    # a page of a harvest holds a bounded number of records
    pages = paper_records(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 100).alias("page")).agg(F.array_join(F.collect_list(tag("record", body)), "").alias("records"))
    pages.select("page", tag("OAI-PMH", tag("ListRecords", F.col("records")))).write.partitionBy("page").text(path)
    return records.read_oai(spark, path).withColumn("authors", F.array_join("authors", "; "))


def store_ingest(spark, sf_dir):
    """Added to an empty store in the order of doc_id, then a second time, which adds nothing."""
    kept = store.Store(spark, scratch_path(spark, "ingest"))
    ordered = paper_records(spark, sf_dir).orderBy("doc_id").drop("doc_id")
    first, second = kept.add(ordered), kept.add(ordered)
    return kept.rows().select("id", "arxiv_id", "title", "primary_category", F.lit(first).cast("long").alias("added"), F.lit(second).cast("long").alias("added_again"))


def word_lookup(spark, sf_dir):
    return lexicon.lookup(vocabulary(spark, sf_dir), _words(spark))


# --- evaluation


def known_item_sample(spark, sf_dir):
    """Known-item evaluation of a reproducible sample of titles."""
    return evaluation.known_item(corpus(spark, sf_dir), SAMPLE)


def known_item_eval(spark, sf_dir):
    return evaluation.known_item(corpus(spark, sf_dir))


def percentiles(spark, sf_dir):
    """Of the text lengths of each category, by nearest rank."""
    docs = _read(spark, sf_dir, "documents")
    lengths = docs.select(F.col("source").alias("category"), F.length("text").cast("long").alias("v"))
    return evaluation.percentiles_by(lengths, "category", "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


QUERIES = {
    f.__name__: f
    for f in (
        tokens_words, tokens_terms, stem_vocab, normalise_docs, published_month, ingest_dedup, store_count, get_documents, keyset_page, naive_search,
        postings, doc_norm, term_idf, vocabulary, title_phrases, phrase_weights, category_counts, engine_stats,
        score_bm25, score_tf, score_match, rank_bm25_topk, rank_category, rank_page, match_total,
        complete_words, complete_phrases, suggest_single, suggest_multi, edit_distance, fuzzy_candidates, spell_correct, correct_query,
        highlight_title, best_snippet, search, stored_search, jsonl_source, oai_source, store_ingest, word_lookup, known_item_sample, known_item_eval, percentiles,
    )
}
