"""Quality rules with risk-controlled thresholds.

Five signals of a text, each a share that is the worse the higher, are cut at thresholds chosen from labelled holdouts,
among the documents that pass the base rule. The labelled documents are dealt by a hash of the identifier:

* One in ``DESIGN_FOLDS`` designs one path for all strata: a sequence of steps, each of which lowers the cutoff of one signal
  on a fixed grid, in the order of what it adds (bad documents against good ones). A document is rejected from the first
  step on whose cutoff it exceeds.
* The others certify it, stratum by stratum (by default the language). Along the path "more than ``alpha`` of the stratum's
  good documents are rejected so far" is refuted by the exact binomial tail probability of the rejections counted among the
  stratum's good documents. The first step that is not refuted ends the sequence (fixed-sequence testing), and the level
  ``delta`` is shared by Bonferroni among the strata. The last certified step is used.

So with probability 1 - delta no stratum loses more than ``alpha`` of its good documents to the method. A stratum stands
alone if it has good labels enough to certify a step without a false rejection (217 for alpha 0.02, delta 0.05 and four
strata); all others form one stratum together, whose guarantee holds for their mixture.

Scale: one pass over the texts gives a narrow table of counts (written once to the shared folder, since the design, the
certification and the verdicts read it); labels join that narrow table; good and bad labels are summed by stratum and step
map-side and certified on the executors. The design reads every labelled document of its fold, none is left out: a document
is to it only how many cutoffs each signal exceeds, so equal ones are counted together. Up to ``max_design`` such counts,
proven by their number, are designed from on the driver; beyond that the executors sum them anew for each step of the path, of
which there are at most signals times cutoffs, and the driver sees at most 240 sums a step. Besides these it sees one number
for each stratum with labels enough to stand alone. The strata's steps are broadcast below ``broadcast_strata`` rows, by
their count, else joined by a shuffle that adaptive execution can split.

Defined results: a null or empty text has no words and fails the base rules; a null stratum is a stratum of its own;
documents labelled twice count once, good only if all their labels say so; a labelled identifier on several rows counts once,
with its smallest stratum and largest counts; without labels nothing is certified and only the base rules act; equal steps of
the path go to the signal named first; very long texts are counted whole; an empty table gives no row; repeated rows give
repeated rows, and only the identifier, text, stratum and label columns are read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from functools import reduce
from itertools import count
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, texts

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = string.ascii_uppercase.encode()
_LETTERS = string.ascii_letters.encode()

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks")
SIGNALS = ("symbols", "dup_lines", "repeats", "capitals", "marks")
#: One labelled document in so many designs the path.
DESIGN_FOLDS = 5
#: Cutoffs from the loosest to the strictest.
GRID = tuple(x / 100 for x in (*range(95, 4, -5), 4, 3, 2, 1))


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """How many words lie in windows of ``n`` words that occur twice or more."""
    if len(words) <= n:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    windows = ids[: len(ids) - n + 1]
    for k in range(1, n):
        # pairs to dense ids step by step, so that no product can overflow
        pair = windows * np.int64(len(ids)) + ids[k : len(ids) - n + 1 + k]
        windows = np.unique(pair, return_inverse=True)[1]
    twice = np.bincount(windows)[windows] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + n, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly 0x20 and 0x09-0x0D
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, _LETTERS)),
        len(raw) - len(raw.translate(None, _CAPITALS)),
        raw.count(b"!"),
    )


def counts(docs: DataFrame, *, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([measure(t) for t in texts(batch)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=["doc_id", "stratum", *COUNTS])

    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def signals() -> dict[str, F.Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(F.lit(0.0))
    return dict(zip(SIGNALS, (share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "n_letters"), share("n_marks", "n_words")), strict=True))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n and p, exact up to rounding."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def design(tally: Callable[[list[int]], np.ndarray]) -> list[tuple[int, int]]:
    """The path as (signal, grid step), from labelled documents.

    A document's level in a signal is how many cutoffs of the grid it exceeds: those from grid step ``len(GRID) - level`` on.
    ``tally`` takes a limit for each signal and counts the documents whose levels are all below: [signal, level, good].
    Each step of the path lowers one signal's cutoff as far as the next bad document; the one with the largest gain comes
    first, and a loss ends the path.
    """
    path: list[tuple[int, int]] = []
    limits = [len(GRID) + 1] * len(SIGNALS)
    left = tally(limits)
    n_bad, n_good = (max(1, int(n)) for n in left[0].sum(axis=0))
    while True:
        best = None
        for k in range(len(SIGNALS)):
            reach = int(np.flatnonzero(left[k, :, 0]).max(initial=0))
            if reach:
                bad, good = left[k, reach:].sum(axis=0)
                gain = bad / n_bad - 5 * good / n_good
                if best is None or gain > best[0]:
                    best = (gain, k, reach)
        if best is None or best[0] <= 0:
            return path
        _, k, limits[k] = best
        path.append((k, len(GRID) - limits[k]))
        left = tally(limits)


def empty_tally() -> np.ndarray:
    return np.zeros((len(SIGNALS), len(GRID) + 1, 2), np.int64)


def tally_here(rows: list) -> Callable[[list[int]], np.ndarray]:
    """For ``design``, of counts that the driver holds. rows: the levels, good, n."""
    table = np.array(rows, np.int64).reshape(-1, len(SIGNALS) + 2)

    def tally(limits: list[int]) -> np.ndarray:
        left, out = table[(table[:, : len(SIGNALS)] < limits).all(axis=1)], empty_tally()
        for k in range(len(SIGNALS)):
            np.add.at(out[k], (left[:, k], left[:, -2]), left[:, -1])
        return out

    return tally


def tally_there(cells: DataFrame) -> Callable[[list[int]], np.ndarray]:
    """The same, summed by the executors."""

    def tally(limits: list[int]) -> np.ndarray:
        below = [F.col(name) < limit for name, limit in zip(SIGNALS, limits, strict=True)]
        left = cells.where(reduce(and_, below)).select("good", "n", F.posexplode(F.array(*SIGNALS)).alias("signal", "level"))
        out = empty_tally()
        for r in left.groupBy("signal", "level", "good").agg(F.sum("n").alias("n")).collect():
            out[r.signal, r.level, r.good] = r.n
        return out

    return tally


def needed(alpha: float, delta: float) -> int:
    """The fewest good documents of which none is rejected that certify a step."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def own_strata(counts: list[int], alpha: float, delta: float) -> int:
    """How many strata, the largest first, can stand alone when one more is tested for all others."""
    ordered = sorted(counts, reverse=True)
    return max((k for k in range(1, len(ordered) + 1) if ordered[k - 1] >= needed(alpha, delta / (k + 1))), default=0)


def certify(false: list[int], n: int, alpha: float, delta: float) -> int:
    """How many steps of the path are certified. false: good documents first rejected by each step."""
    rejected = 0
    for step, new in enumerate(false):
        rejected += new
        if n == 0 or binomial_tail(rejected, n, alpha) > delta:
            return step
    return len(false)


def labelled(measured: DataFrame, labels: DataFrame, good: F.Column, id_col: str) -> DataFrame:
    """stratum, counts, good and fold of the labelled documents that pass the base rule."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), good.cast("int").alias("good")).where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    once = measured.groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.max("base_failed").alias("base_failed"), *(F.max(c).alias(c) for c in COUNTS))
    return once.where("not base_failed").join(marked, "doc_id").withColumn("hash", F.xxhash64("doc_id"))


def first_step(path: list[tuple[int, int]]) -> F.Column:
    """The first step of the path that rejects a document, or null."""
    values = list(signals().values())
    return F.coalesce(*(F.when(values[k] > GRID[g], F.lit(i)) for i, (k, g) in enumerate(path)), F.lit(None).cast("int"))


def certified(held: DataFrame, path: list[tuple[int, int]], alpha: float, delta: float) -> DataFrame:
    """stratum, alone, n_good, steps (how many are certified): one row a stratum with labels."""
    is_design = F.pmod("hash", F.lit(DESIGN_FOLDS)) == 0
    tested = held.where(~is_design).withColumn("step", first_step(path))
    by_step = tested.where("good = 1").groupBy("stratum", "step").agg(F.count("*").alias("n"))
    sizes = tested.groupBy("stratum").agg(F.sum("good").alias("n_good"))
    counts = [r.n_good for r in sizes.where(F.col("n_good") >= needed(alpha, delta)).select("n_good").collect()]
    alone = own_strata(counts, alpha, delta)
    tests = alone + 1
    least = F.lit(sorted(counts, reverse=True)[alone - 1] if alone else 1 << 62)
    named = sizes.select(F.col("stratum").alias("s"), (F.col("n_good") >= least).alias("alone"))
    known = by_step.join(named, F.col("stratum").eqNullSafe(F.col("s")))
    # strata that cannot stand alone are summed as one
    together = known.groupBy("alone", F.when(F.col("alone"), F.col("s")).alias("group"), "step").agg(F.sum("n").alias("n"))
    lists = together.groupBy("alone", "group").agg(F.collect_list(F.struct("step", "n")).alias("found"))

    def run(batches):
        for batch in batches:
            sums, steps = [], []
            for found in batch.column(2).to_pylist():
                false = [0] * len(path)
                for x in found:
                    if x["step"] is not None:
                        false[x["step"]] += x["n"]
                sums.append(sum(x["n"] for x in found))
                steps.append(certify(false, sums[-1], alpha, delta / tests))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64()), pa.array(steps, pa.int64())], names=["alone", "group", "n_good", "steps"])

    done = lists.mapInArrow(run, "alone boolean, group string, n_good long, steps long")
    same = (named["alone"] == done["alone"]) & F.when(named["alone"], named["s"]).eqNullSafe(done["group"])
    return named.join(done, same).select(F.col("s").alias("stratum"), named["alone"], "n_good", "steps")


def thresholds(measured: DataFrame, labels: DataFrame, scratch: Scratch, *, alpha: float, delta: float, max_design: int, good: F.Column, id_col: str = "doc_id") -> tuple[list[tuple[int, int]], DataFrame]:
    """The path, and per stratum how many of its steps are certified."""
    held = labelled(measured, labels, good, id_col)
    exceeded = [sum((s > g).cast("int") for g in GRID).alias(name) for name, s in signals().items()]
    designing = held.where(F.pmod("hash", F.lit(DESIGN_FOLDS)) == 0).select("good", *exceeded)
    cells = scratch.keep(designing.groupBy(*SIGNALS, "good").agg(F.count("*").alias("n")))
    few = cells.count() <= max_design
    path = design(tally_here(cells.collect()) if few else tally_there(cells))
    return path, certified(held, path, alpha, delta)


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    alpha: float = 0.02,
    delta: float = 0.05,
    max_design: int = 20_000,
    broadcast_strata: int = 200_000,
    min_words: int = 50,
    stratum_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Per document its counts, ``base_failed``, the signal that rejects it (or null), ``kept``, and whether its stratum has a certified step."""
    scratch = Scratch(docs.sparkSession, "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = scratch.keep(counts(docs, stratum_col=stratum_col, id_col=id_col, text_col=text_col).withColumn("base_failed", failed))
    path, found = thresholds(measured, labels, scratch, alpha=alpha, delta=delta, max_design=max_design, good=F.col(label_col) > 0, id_col=id_col)
    found = scratch.keep(found)
    cuts = found.where("steps > 0").select(F.col("stratum").alias("s"), "steps")
    few = cuts.count() <= broadcast_strata
    step = first_step(path)
    name = F.coalesce(*(F.when(step == i, F.lit(SIGNALS[k])) for i, (k, _) in enumerate(path)), F.lit(None).cast("string"))
    rejected = F.when(step < F.col("steps"), name)
    joined = measured.join(F.broadcast(cuts) if few else cuts, F.col("stratum").eqNullSafe(F.col("s")), "left")
    return joined.select("doc_id", "stratum", *COUNTS, "base_failed", rejected.alias("rejected_by"), (~F.col("base_failed") & rejected.isNull()).alias("kept"), F.col("steps").isNotNull().alias("certified"))


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns of what ``apply_rules`` returns."""
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "certified")
