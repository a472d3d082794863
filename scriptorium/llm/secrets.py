"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The models are two first-order character chains with additive smoothing, trained from labelled samples: random strings
over the usual alphabets of keys, and identifiers (words of programs, joined in the usual styles, with version-like digits; runs of
one character) together with ordinary words drawn from the corpus. A candidate is a run of at least ``min_length`` characters
``[A-Za-z0-9+/_=-]``, or what is left of one beside the fixed spans; it is a secret when the mean log-likelihood ratio per
character exceeds the threshold for its length. A mean over few characters varies more, so the thresholds are calibrated by
length: each is the highest score among all windows of that length in the ordinary samples kept out of training, plus a margin.

Fixed kinds, leftmost and not overlapping within a kind: ``assign`` (a keyword, ``:`` or ``=``, a value of 8 or more
characters; the span is the whole match), ``access`` and ``hex``. ``random`` is the method's kind; it overlaps no fixed span.

Scale: one pass, no shuffle. The models are a few thousand numbers, whatever the corpus.

Defined results: null and empty texts have no span; repeated rows give repeated rows; spans are in code points; spans that
begin together come in the order of the kinds; a score equal to its threshold is no secret; very long texts take time in
proportion to their length; an empty table gives no row; only the identifier and text are read, so no column name clashes.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import id_text, map_whole_rows, texts

KINDS = ("assign", "access", "hex", "random")
# The patterns that the contract names.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CODE = {c: i for i, c in enumerate(_ALPHABET)}
_FOLD = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_HEX_RUN = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_CANDIDATE_RUN = bytes(0x68 if chr(b) in _ALPHABET else 0x20 for b in range(256))

#: Words that make up the names in programs, for the samples of ordinary identifiers.
PROGRAM_WORDS = tuple(
    """
    account action active address agent alias align all append apply archive argument array async attribute audio author
    background backup base batch begin binary block body boolean border bottom bound branch browser buffer build button byte
    cache calendar callback cancel category center chain change channel character check child class clean client clock close
    cluster code collect color column command comment commit common compare compile complete component config connect console
    constant contact container content context control convert cookie copy core count country create current cursor custom
    data date debug decode default define delete depth device dialog digest directory disable display document domain download
    draft driver dynamic edit element email enable encode engine entry error event exact except execute exit export extension
    factory false field file filter final first flag float flush folder font format forward frame from function gateway general
    generate get global graph group handler hash header height helper history home host
    """.split()
)

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def random_samples(rng: np.random.Generator, n: int) -> list[str]:
    """Labelled samples of random strings over the usual alphabets."""
    kinds = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", _ALPHABET)
    out = []
    for i in range(n):
        letters = np.array(list(kinds[i % len(kinds)]))
        out.append("".join(rng.choice(letters, rng.integers(16, 65))))
    return out


def identifier_samples(rng: np.random.Generator, n: int) -> list[str]:
    """Labelled samples of ordinary runs: words of programs joined in the usual styles, and single characters repeated."""
    out = []
    for i in range(n):
        parts = [PROGRAM_WORDS[k] for k in rng.integers(0, len(PROGRAM_WORDS), rng.integers(2, 6))]
        tail = ("", "", str(rng.integers(0, 100)), f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}")[i // 8 % 4]
        join, form = (("_", str), ("-", str), ("/", str), ("", str.capitalize), ("", str), ("_", str.upper), ("", str.upper), ("-", str.capitalize))[i % 8]
        out.append(join.join(map(form, parts)) + tail)
    # rules and fillers: runs of one character
    return out + [c * int(k) for c in _ALPHABET for k in rng.integers(8, 41, 8)]


def _encode(s: str) -> np.ndarray:
    return np.fromiter(map(_CODE.__getitem__, s), np.int64, len(s))


class MarkovRatio:
    """Log-likelihood ratio of two character chains, per character."""

    #: Lengths that have a threshold of their own.
    LENGTHS = (16, 20, 24, 32, 48)

    def __init__(self, random: list[str], ordinary: list[str], smoothing: float = 0.5, margin: float = 0.1):
        keep = max(1, len(ordinary) // 4)
        self.table = self._chain(random, smoothing) - self._chain(ordinary[keep:], smoothing)
        whole = max([0.0, *(self.score(s) for s in ordinary[:keep] if len(s) >= 8)])
        self.thresholds = [max([whole, *(w for s in ordinary[:keep] for w in self._windows(s, n))]) + margin for n in self.LENGTHS]

    @staticmethod
    def _chain(samples: list[str], smoothing: float) -> np.ndarray:
        n = len(_ALPHABET)
        counts = np.full((n, n), smoothing)
        for s in samples:
            codes = _encode(s)
            np.add.at(counts, (codes[:-1], codes[1:]), 1.0)
        return np.log(counts / counts.sum(axis=1, keepdims=True))

    def _windows(self, s: str, n: int) -> list[float]:
        """Scores of all runs of ``n`` characters."""
        if len(s) < n:
            return []
        codes = _encode(s)
        upto = np.concatenate([[0.0], np.cumsum(self.table[codes[:-1], codes[1:]])])
        return ((upto[n - 1 :] - upto[: len(upto) - n + 1]) / (n - 1)).tolist()

    def score(self, s: str) -> float:
        codes = _encode(s)
        return float(self.table[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def is_random(self, s: str) -> bool:
        return self.score(s) > self.thresholds[max(0, bisect_right(self.LENGTHS, len(s)) - 1)]


def corpus_words(docs: DataFrame, n: int) -> list[str]:
    """A bounded sample of runs of ASCII letters in the corpus: ordinary by their label, since they hold no digit.

    One word each of about ``n`` documents, drawn by a hash of the identifier at a rate that the number of rows sets; at
    most 2n words reach the driver.
    """
    rate = n / max(n, docs.count())
    drawn = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < round(rate * (1 << 30))) & F.col("text").isNotNull())
    word = F.lit(r"(?<![\w+/=-])[A-Za-z][a-z]{7,40}(?![\w+/=-])")
    found = drawn.select(F.try_element_at(F.regexp_extract_all("text", word, F.lit(0)), F.lit(1)).alias("word")).where("word is not null")
    # the smallest hashes, whatever the order of rows
    return sorted(r.word for r in found.orderBy(F.xxhash64("word"), "word").limit(2 * n).collect())


def train(rows: DataFrame, sample_docs: int, samples: int, seed: int) -> MarkovRatio:
    rng = np.random.default_rng(seed)
    ordinary = [*identifier_samples(rng, samples), *corpus_words(rows, sample_docs)]
    return MarkovRatio(random_samples(rng, samples), [ordinary[i] for i in rng.permutation(len(ordinary))])


def base_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """The fixed kinds. Cheap searches of bytes come first, since few texts hold any."""
    out = []
    folded = raw.translate(_FOLD)
    if any(k in folded for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in raw.translate(_HEX_RUN):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def scan_text(text: str | None, model: MarkovRatio, min_length: int) -> list[tuple[str, int, int]]:
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    out = base_spans(text, raw)
    if b"h" * min_length in raw.translate(_CANDIDATE_RUN):
        fixed = sorted((a, b) for _, a, b in out)
        k = 0
        for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{min_length},}}", text):
            at, end = m.span()
            # both are in order: spans that end before a run are left behind
            while k < len(fixed) and fixed[k][1] <= at:
                k += 1
            i = k
            while at < end:
                while i < len(fixed) and fixed[i][1] <= at:
                    i += 1
                stop = min(end, fixed[i][0]) if i < len(fixed) else end
                if stop - at >= min_length and model.is_random(text[at:stop]):
                    out.append(("random", at, stop))
                at = max(stop, fixed[i][1]) if i < len(fixed) else end
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, *, min_length: int = 16, sample_docs: int = 500, samples: int = 4000, seed: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its spans (kind, start, end), by start, then kind."""
    rows = id_text(docs, id_col, text_col)
    model = train(rows, sample_docs, samples, seed)

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan_text(t, model, min_length)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, *, mark: str = "[SECRET]", length_col: str | None = None, min_length: int = 16, sample_docs: int = 500, samples: int = 4000, seed: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span of ``scan`` replaced by ``mark``; overlapping spans are replaced as one."""
    model = train(id_text(docs, id_col, text_col), sample_docs, samples, seed)

    def clean(text: str | None) -> str | None:
        end, out = 0, []
        for _, a, b in scan_text(text, model, min_length):
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]]) if out else text

    def run(batches, k):
        for batch in batches:
            yield batch.set_column(k, batch.schema.names[k], pa.array([clean(t) for t in texts(batch, k)], batch.schema.field(k).type))

    out = map_whole_rows(docs, text_col, run)
    return out if length_col is None else out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``scan`` returns."""
    base = F.filter("spans", lambda s: s.kind != "random")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
