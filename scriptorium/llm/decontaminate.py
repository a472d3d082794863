"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of every benchmark item (a shorter item is one pattern).
For each pattern length m there is one searcher: blocks of two words (one if m is 1) give a shift table that skips
positions where no pattern can end, the block at the end of a window selects a bucket, its first block a sub-bucket,
and the strings found there are compared word by word.

Scale: documents are read once and never shuffled. The patterns reach the executors as broadcast blocks of at most
``block_words`` words, cut by the measured size of the benchmark, through the driver one block at a time. With more than one
block every block has a pass over the documents of its own, whose tasks build that block's tables once and hold no other;
only texts with hits leave a pass, by their SHA-256, and are put together and joined to the documents.

Defined results: a null or empty text has no words; an item with a null id or without words is ignored; items with
the same id count as one item with several texts; repeated documents give repeated rows; very long texts are searched
whole, one at a time; there are no ties, since every occurrence counts; an empty table gives no row, an empty benchmark
hits nothing; only the identifier and text are read, so no column name clashes.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER_BYTES, Scratch, fresh_name, id_text, map_whole_rows, texts

#: Words are runs of ASCII letters, digits and bytes of non-ASCII characters.
_TO_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER_BYTES)

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class WuManber:
    """Patterns of one length, each a tuple of words with the set of items it comes from."""

    def __init__(self, patterns: dict[tuple, set]):
        self.m = m = len(next(iter(patterns)))
        self.block = block = min(2, m)
        self.longest_shift = m - block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for p, items in patterns.items():
            for end in range(block, m + 1):
                key = p[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.longest_shift), m - end)
            self.buckets.setdefault(p[-block:], {}).setdefault(p[:block], []).append((p, items))

    def occurrences(self, words: list[bytes]):
        """(start, items) of each occurrence, by start."""
        m, block, longest, shift = self.m, self.block, self.longest_shift, self.shift.get
        end, n = m, len(words)
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            skip = shift(key, longest)
            if skip:
                end += skip
                continue
            start = end - m
            for pattern, items in self.buckets[key].get(tuple(words[start : start + block]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, items
            end += 1


def searchers(items: list[tuple[str, str]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(item)
    return [WuManber(p) for _, p in sorted(by_length.items())]


def _merge(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search(finders: list[WuManber], words: list[bytes]) -> tuple[set, list[tuple[int, int]]]:
    """The items that occur and the merged spans of their windows."""
    names: set = set()
    spans = []
    for f in finders:
        for start, items in f.occurrences(words):
            names.update(items)
            spans.append((start, start + f.m))
    return names, _merge(spans)


def ship(benchmark: DataFrame, block_words: int, item_col: str, text_col: str) -> list:
    """The items with a text as broadcast blocks of about ``block_words`` words, by the benchmark's measured size."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    characters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-characters // (block_words * 6)))
    part = lambda k: items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
    return [sc.broadcast([(r.item, r.text) for r in part(k).toLocalIterator()]) for k in range(blocks)]


def _spans_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)


def _hits(rows: DataFrame, shipped: list, window: int) -> DataFrame:
    """key, items, spans of the texts with a hit in any of several blocks. rows: key, text."""

    def of(block):
        def run(batches):
            finders = searchers(block.value, window)
            for batch in batches:
                found = [search(finders, words_of(t)) for t in texts(batch)]
                hit = [i for i, (_, spans) in enumerate(found) if spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64())), pa.array([sorted(found[i][0]) for i in hit], pa.list_(pa.string())), _spans_array([found[i][1] for i in hit])], names=["key", "items", "spans"])

        # copies of a text are one row of a block
        return rows.mapInArrow(run, "key string, items array<string>, spans array<struct<start:long,end:long>>").groupBy("key").agg(F.first("items").alias("items"), F.first("spans").alias("spans"))

    parts = reduce(DataFrame.unionAll, map(of, shipped))
    # at most one row of each block
    return parts.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))


def _key() -> F.Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 2_000_000, broadcast_hits: int = 100_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per document: its words, the words inside any occurrence, the items that occur, the hit spans in words."""
    shipped = ship(benchmark, block_words, item_col, item_text_col)
    rows = id_text(docs, id_col, text_col)
    if len(shipped) > 1:
        hits = Scratch(docs.sparkSession, "decontaminate").keep(_hits(rows.select(_key().alias("key"), "text"), shipped, window))
        few = hits.count() <= broadcast_hits
        rows = rows.withColumn("key", _key()).join(F.broadcast(hits) if few else hits, "key", "left").select("doc_id", "text", "items", "spans")

    def run(batches):
        finders = searchers(shipped[0].value, window) if len(shipped) == 1 else None
        for batch in batches:
            sizes, names, spans = [], [], []
            for i, text in enumerate(texts(batch)):
                words = words_of(text)
                sizes.append(len(words))
                if finders is not None:
                    found, at = search(finders, words)
                else:
                    found = batch.column(2)[i].as_py() or ()
                    at = _merge([(s["start"], s["end"]) for s in batch.column(3)[i].as_py() or ()])
                names.append(sorted(found))
                spans.append(at)
            hit = pa.array([sum(b - a for a, b in s) for s in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), hit, pa.array(names, pa.list_(pa.string())), _spans_array(spans)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return rows.mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 2_000_000, broadcast_hits: int = 100_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, in which no window occurs."""
    shipped = ship(benchmark, block_words, item_col, item_text_col)
    if len(shipped) > 1:
        rows = docs.select(F.col(text_col).cast("string").alias("text"))
        hits = Scratch(docs.sparkSession, "decontaminate").keep(_hits(rows.select(_key().alias("key"), "text"), shipped, window).select("key"))
        key = fresh_name(docs, "key")
        hits = hits.toDF(key)
        few = hits.count() <= broadcast_hits
        return docs.join(F.broadcast(hits) if few else hits, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256) == F.col(key), "left_anti")

    def run(batches, k):
        finders = searchers(shipped[0].value, window)
        for batch in batches:
            yield batch.filter(pa.array([not search(finders, words_of(t))[1] for t in texts(batch, k)], pa.bool_()))

    return map_whole_rows(docs, text_col, run)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``decontaminate`` returns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
hit AS (SELECT win.doc_id, win.m, win.i, p.item FROM win JOIN p ON win.m = p.m AND win.s = p.s),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
