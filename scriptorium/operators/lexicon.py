"""Weighted keys (key, weight): prefix completion, fuzzy search and spelling correction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def weighted(spark: SparkSession, entries: list[tuple[str, int]]) -> DataFrame:
    """Keys with weights; a repeated key keeps the last weight."""
    for key, weight in entries:
        if not key or weight <= 0:
            raise ValueError("a key must not be empty and its weight must be positive")
    return spark.createDataFrame(list(dict(entries).items()), "key string, weight long")


def complete(keys: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """The heaviest keys with the prefix, ties by key. On sorted Parquet the prefix is pushed to the scan."""
    return keys.where(F.startswith("key", F.lit(prefix))).orderBy(F.desc("weight"), "key").limit(max(0, limit))


def lookup(keys: DataFrame, queries: DataFrame) -> DataFrame:
    """word, its weight (0 if it is no key) and whether it is one, for each of ``queries`` (one column, word)."""
    words = queries.select("word").distinct()
    found = words.join(keys.select(F.col("key").alias("word"), "weight"), "word", "left")
    return found.select("word", F.coalesce("weight", F.lit(0)).alias("weight"), F.col("weight").isNotNull().alias("known"))


def _deletions(word: Column, distance: int) -> Column:
    """The word with up to ``distance`` letters left out, each result once."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out, last = F.array(word), F.array(word)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, once)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def fuzzy(keys: DataFrame, queries: DataFrame, max_distance: int, limit: Column | None = None) -> DataFrame:
    """word, key, distance, weight for all keys within the distance of a word of ``queries`` (one column, word).

    ``limit``: a distance of each word's own, at most ``max_distance``.

    Two strings within d edits share a string that d deletions make of each, so candidates come from an equi-join on
    deletions instead of a comparison of all pairs; they are then compared exactly.
    """
    words = queries.select("word").where("word is not null").distinct()
    within = F.lit(max_distance) if limit is None else limit
    lengths = words.select(F.explode(F.sequence(F.length("word") - within, F.length("word") + within)).alias("n")).distinct()
    near = keys.join(lengths, F.length("key") == F.col("n"), "left_semi")
    left = words.select("word", F.explode(_deletions(F.col("word"), max_distance)).alias("part"))
    right = near.select("key", "weight", F.explode(_deletions(F.col("key"), max_distance)).alias("part"))
    pairs = left.join(right, "part").select("word", "key", "weight").distinct()
    guarded = pairs.where((F.abs(F.length("word") - F.length("key")) <= max_distance) & (F.levenshtein("word", "key", 2 * max_distance) >= 0))
    return guarded.withColumn("distance", T.edit_distance(F.col("word"), F.col("key"))).where(F.col("distance") <= within).select("word", "key", "distance", "weight")


def correct(keys: DataFrame, queries: DataFrame, max_distance: int | None = None) -> DataFrame:
    """word and correction (null if the word is shorter than 3, known, or nothing is close).

    Fewest edits first, then the heaviest key, then the first. One edit for words of up to 4 letters and two for longer
    ones, unless ``max_distance`` says otherwise.
    """
    words = queries.select("word").distinct()
    unknown = words.where(F.length("word") >= 3).join(keys.select(F.col("key").alias("word")), "word", "left_anti")
    own = F.when(F.length("word") <= 4, 1).otherwise(2)
    found = fuzzy(keys, unknown, 2, own) if max_distance is None else fuzzy(keys, unknown, max_distance)
    best = found.groupBy("word").agg(F.min_by("key", F.struct("distance", -F.col("weight"), "key")).alias("correction"))
    return words.join(best, "word", "left")


class HeldKeys:
    """Keys of a checked number on the driver (key, weight), for the few words of one request.

    The same results as ``correct``: a word is compared with all keys of nearly its length at once.
    """

    def __init__(self, table: pa.Table):
        self.keys = table["key"].combine_chunks()
        self.weights = table["weight"].to_numpy()
        self.lengths = pc.utf8_length(self.keys).to_numpy(zero_copy_only=False)
        self.names = set(self.keys.to_pylist())
        self._letters: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of_length(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys of ``n`` letters, and their letters by place in the key."""
        if n not in self._letters:
            at = np.flatnonzero(self.lengths == n)
            letters = np.array(self.keys.take(pa.array(at)).to_pylist(), f"U{n}").view(np.uint32).reshape(len(at), n)
            self._letters[n] = at, np.ascontiguousarray(letters.T)
        return self._letters[n]

    def nearest(self, word: str, distance: int) -> tuple[str, int] | None:
        """The key of the fewest edits, at most ``distance``, then the heaviest, then the first; with its weight."""
        best = None
        for n in range(max(1, len(word) - distance), len(word) + distance + 1):
            at, letters = self._of_length(n)
            edits = _edits(word, letters)
            for i in np.flatnonzero(edits <= distance).tolist():
                found = (int(edits[i]), -int(self.weights[at[i]]), self.keys[int(at[i])].as_py())
                best = found if best is None else min(best, found)
        return best and (best[2], -best[1])

    def correct(self, word: str, df: int, rare_word_factor: int) -> str | None:
        """The replacement of a word that ``df`` documents hold, or null: keep it."""
        if len(word) < 3 or word in self.names:
            return None
        if df == 0:
            found = self.nearest(word, 1 if len(word) <= 4 else 2)
            return found and found[0]
        found = self.nearest(word, 1)
        return found[0] if found and found[1] >= rare_word_factor * df else None


def _edits(word: str, letters: np.ndarray) -> np.ndarray:
    """Inserts, deletes, replacements and swaps of neighbours between the word and each column of ``letters``."""
    n, many = letters.shape
    codes = [ord(c) for c in word]
    last = np.repeat(np.arange(n + 1, dtype=np.int32)[:, None], many, axis=1)
    before = last
    for i, code in enumerate(codes):
        row = np.full_like(last, i + 1)
        for j in range(n):
            cell = np.minimum(last[j] + (letters[j] != code), np.minimum(last[j + 1], row[j]) + 1)
            if i and j:
                swapped = (letters[j - 1] == code) & (letters[j] == codes[i - 1])
                cell = np.where(swapped, np.minimum(cell, before[j - 1] + 1), cell)
            row[j + 1] = cell
        before, last = last, row
    return last[n]
