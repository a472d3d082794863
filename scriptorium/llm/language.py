"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a space, and its byte n-grams (2, 3 and 4 long, spaces at word ends
included) are hashed to ``buckets`` rows of an embedding table. The mean row goes through a linear softmax. Embedding and
softmax are trained together by stochastic gradient descent in numpy, on whole texts and, so that short texts work too,
on one short span of each. A part of the sample is kept to fit the softmax temperature.

A softmax is sure of one of its languages on any text, so rejection has a measure of its own: the familiarity of a text is
the mean log-probability of its n-grams in the predicted language (n-gram frequencies of the training part, mixed with one
tenth of the uniform distribution). A second sample, disjoint from the training sample, gives familiarities of whole texts
and of ``SPANS`` spans of 4 to 4,000 characters of each. The ``reject`` quantile of these, by length, is the threshold (split
conformal: a text of a learned language falls below it with at most about that probability). Length classes are powers of
two of the number of n-grams, joined until each has ``10 / reject`` examples, so that the tenth lowest or a later one
decides; a corpus too small for one such class has a single class, and one too small for the quantile takes the lowest
example, whose chance is one in the number of examples.

Scale: one aggregate over (lang) sizes the sample; at most about ``max_train_docs`` documents are hashed on the executors and
their bucket counts collected (at most ``buckets`` numbers each); of at most about ``max_calibration_docs`` documents two
numbers each part are collected; prediction is one pass without a shuffle with the folded table and the familiarities (buckets
x languages each) as a broadcast, since mean and linear layer commute.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text when there is
nothing to learn from. Languages of fewer than 40 rows are learned from all of them and not calibrated; without any
calibration example nothing with a letter is rejected. Only the text is an input of a prediction. A null identifier counts as the empty text for the fold.
However many languages
there are, all are learned, from one row each at least. Very long texts are taken whole. Equal probabilities go to the
language that comes first by name; the samples are the rows with the smallest hashes of their identifiers, so they do not
depend on the order of rows. An empty table gives no row; only the identifier, text and language are read, so no column name
clashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import map_whole_rows, texts

UNKNOWN = "und"
#: Spans of each calibration text.
SPANS = 4
_NOT_LETTERS = bytes(0x20 if b < 0x80 and not chr(b).isalpha() else b for b in range(256))
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def subwords(text: str, buckets: int) -> np.ndarray:
    """Bucket numbers of all n-grams."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_NOT_LETTERS).split()) + b" "
    one = np.frombuffer(raw, np.uint8).astype(np.uint32)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    out, gram = [], one
    for n in range(2, 5):
        if len(one) < n:
            break
        gram = (gram[:-1] << np.uint32(8)) | one[n - 1 :]
        out.append(((gram ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> shift)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class Model:
    """languages, table (buckets x languages), bias, temperature, familiar (languages x buckets: log-probabilities), and by length class its first number of n-grams and its threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, familiar: np.ndarray):
        self.languages, self.table, self.bias, self.temperature, self.familiar = languages, table, bias, temperature, familiar
        self.starts, self.thresholds = np.zeros(1, np.int64), np.full(1, -np.inf)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(1.0, counts.sum()) + self.bias

    def measure(self, text: str) -> tuple[int, float, int, float]:
        """Predicted language, its probability, number of n-grams, familiarity."""
        found = subwords(text, len(self.table))
        if len(found) < len(self.table):
            z = self.table[found].sum(axis=0) / max(1, len(found)) + self.bias
        else:
            z = self.logits(np.bincount(found, minlength=len(self.table)).astype(np.float32))
        p = softmax(z.astype(np.float64) / self.temperature)
        k = int(p.argmax())
        return k, float(p[k]), len(found), float(self.familiar[k][found].mean(dtype=np.float64))

    def calibrate(self, sizes: np.ndarray, familiarities: np.ndarray, reject: float) -> None:
        """Thresholds from the numbers of n-grams and the familiarities of the calibration examples."""
        if not len(sizes):
            return
        order = np.lexsort((familiarities, sizes))
        sizes, familiarities = sizes[order], familiarities[order]
        least, starts, at = int(np.ceil(10 / reject)), [0], [0]
        for edge in 2 ** np.arange(5, 40):
            i = int(np.searchsorted(sizes, edge))
            if i - at[-1] >= least and len(sizes) - i >= least:
                starts.append(int(edge))
                at.append(i)
        parts = [np.sort(x) for x in np.split(familiarities, at[1:])]
        self.starts = np.array(starts)
        self.thresholds = np.array([x[max(0, int(np.floor(reject * (len(x) + 1))) - 1)] for x in parts])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        k, p, size, familiarity = self.measure(text)
        return self.languages[k], p, bool(familiarity < self.thresholds[np.searchsorted(self.starts, size, "right") - 1])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[str, np.ndarray, np.ndarray]], buckets: int, *, dim: int = 16, epochs: int = 8, rate: float = 0.4, seed: int = 5) -> Model:
    """examples: language, bucket numbers, their counts."""
    languages = sorted({x for x, _, _ in examples})
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, np.zeros((0, buckets), np.float32))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    code = {x: i for i, x in enumerate(languages)}
    held = order[: len(order) // 4] if len(order) >= 40 else order
    used = order[len(order) // 4 :] if len(order) >= 40 else order
    embedding = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    linear, bias = rng.normal(0, 1, (dim, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, total = 0, epochs * len(used)
    for _ in range(epochs):
        for i in rng.permutation(used):
            lang, idx, n = examples[i]
            if not len(idx):
                continue
            w = n / n.sum()
            hidden = w @ embedding[idx]
            error = softmax(hidden @ linear + bias)
            error[code[lang]] -= 1
            lr = rate * (1 - steps / total)
            back = linear @ error
            linear -= lr * np.outer(hidden, error)
            bias -= lr * 0.1 * error
            # the mean spreads the gradient over many rows; scaling by their number keeps the steps of usual size
            embedding[idx] -= lr * len(idx) * np.outer(w, back) * 0.05
            steps += 1
    table = (embedding @ linear).astype(np.float32)
    seen = np.zeros((len(languages), buckets), np.float32)
    for lang, idx, n in (examples[i] for i in used):
        if len(idx):
            seen[code[lang], idx] += n / n.sum()
    share = seen / np.maximum(seen.sum(axis=1, keepdims=True), np.float32(1))
    model = Model(languages, table, bias, 1.0, np.log(np.float32(0.9) * share + np.float32(0.1 / buckets)))
    z = np.array([(n @ table[idx]) / max(1, n.sum()) + bias for _, idx, n in (examples[i] for i in held)], np.float64)
    right = np.array([code[examples[i][0]] for i in held])
    losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), right], 1e-12)).mean() for t in np.geomspace(0.05, 5, 41)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def fit(
    docs: DataFrame,
    *,
    buckets: int = 1 << 15,
    max_train_docs: int = 2400,
    max_calibration_docs: int = 20_000,
    reject: float = 0.001,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    **options,
) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train([], buckets)
    share, extra = (max(1, m // len(sizes)) for m in (max_train_docs, max_calibration_docs))
    spark = docs.sparkSession
    chances = [(lang, 1.0 if n < 40 else min(0.7, share / n), extra / n) for lang, n in sizes.items()]
    chance = spark.createDataFrame(chances, "lang string, chance double, extra double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.withColumn("draw", draw).join(F.broadcast(chance), "lang")
    some = drawn.where("draw < chance").select("lang", "text", "draw")
    others = drawn.where("draw >= chance and draw < chance + extra").select("text", "draw")

    def run(batches):
        for batch in batches:
            langs, ids, ns, draws = [], [], [], []
            for lang, text, draw in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                # the whole text and a span of 40 to 200 characters at a place that the draw decides
                rng = np.random.default_rng(int(draw * (1 << 30)))
                length = int(rng.integers(40, 201))
                at = int(rng.integers(0, max(1, len(text) - length + 1)))
                for part in (text, text[at : at + length]):
                    if has_letter(part):
                        found, n = np.unique(subwords(part, buckets), return_counts=True)
                        langs.append(lang)
                        ids.append(found.astype("<u4").tobytes())
                        ns.append(n.astype("<u4").tobytes())
                        draws.append(draw)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.binary()), pa.array(ns, pa.binary()), pa.array(draws, pa.float64())], names=["lang", "ids", "n", "draw"])

    # the limit only matters where very many rows share one identifier and are all drawn
    counted = some.mapInArrow(run, "lang string, ids binary, n binary, draw double").orderBy("draw", "lang", "ids", "n").limit(4 * max(max_train_docs, len(sizes)))
    found = sorted((r.lang, bytes(r.ids), bytes(r.n)) for r in counted.toLocalIterator())
    model = train([(lang, np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(n, "<u4").astype(np.float32)) for lang, i, n in found], buckets, **options)
    if not model.languages:
        return model
    shared = spark.sparkContext.broadcast(model)

    def measured(batches):
        m = shared.value
        for batch in batches:
            sizes, familiarities, draws = [], [], []
            for text, draw in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                rng = np.random.default_rng(int(draw * (1 << 30)))
                parts = [text]
                for length in np.exp(rng.uniform(np.log(4), np.log(4001), SPANS)).astype(int):
                    at = int(rng.integers(0, max(1, len(text) - length + 1)))
                    parts.append(text[at : at + length])
                for part in filter(has_letter, parts):
                    *_, size, familiarity = m.measure(part)
                    sizes.append(size)
                    familiarities.append(familiarity)
                    draws.append(draw)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(familiarities, pa.float64()), pa.array(draws, pa.float64())], names=["size", "familiarity", "draw"])

    # the limit as above
    held = others.mapInArrow(measured, "size long, familiarity double, draw double").orderBy("draw", "size", "familiarity").limit(2 * (SPANS + 1) * max(max_calibration_docs, len(sizes)))
    pairs = np.array([(r[0], r[1]) for r in held.toLocalIterator()], np.float64).reshape(-1, 2)
    shared.destroy()
    model.calibrate(pairs[:, 0], pairs[:, 1], reject)
    return model


def held_out(doc_id: F.Column) -> F.Column:
    """The fold that no model sees: crc32 of the identifier as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The identifier as it is, held_out, lang_pred, score and rejected of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kinds = {"lang_pred": (T.StringType(), pa.string()), "score": (T.DoubleType(), pa.float64()), "rejected": (T.BooleanType(), pa.bool_())}
    schema = T.StructType([*rows.schema.fields[:2], *(T.StructField(n, t) for n, (t, _) in kinds.items())])

    def run(batches):
        m = shared.value
        for batch in batches:
            found = [m.predict(t) for t in texts(batch)]
            columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "held_out", *kinds])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches, k):
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not m.predict(t)[2] for t in texts(batch, k)], pa.bool_()))

    return map_whole_rows(docs, text_col, run)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fit on the documents themselves and predict all of them: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return predict(docs, model, id_col=id_col, text_col=text_col)
