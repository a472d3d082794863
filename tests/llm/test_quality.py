import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import quality
from tests.llm.conftest import clashing, prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x85\xa0|", max_size=60))
def test_counts(text):
    assert quality.measure(text)[:5] == brute(text)


def test_binomial_tail():
    for k, n, p in [(0, 10, 0.1), (3, 10, 0.3), (10, 10, 0.5), (7, 500, 0.02)]:
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_certify():
    assert quality.needed(0.02, 0.05 / 4) == 217
    assert quality.certify([0, 0, 0], 217, 0.02, 0.0125) == 3 and quality.certify([0, 0, 0], 216, 0.02, 0.0125) == 0
    assert quality.certify([0, 200, 0], 5000, 0.02, 0.01) == 1  # a step that rejects too many ends the sequence
    assert quality.certify([0], 0, 0.02, 0.01) == 0
    assert quality.own_strata([3000, 400, 217, 100], 0.02, 0.05) == 3 and quality.own_strata([100], 0.02, 0.05) == 0


def test_guarantee_by_simulation():
    """Over many draws of labels the share with a stratum that truly loses more than alpha is at most delta."""
    rng = np.random.default_rng(12)
    alpha, delta, strata = 0.02, 0.1, 3
    # true share of good documents that each step newly rejects, by stratum; the last steps reject too many
    risks = np.array([[0.002, 0.006, 0.012, 0.02], [0.0, 0.019, 0.003, 0.2], [0.021, 0.0, 0.0, 0.1]])
    sizes = (400, 900, 2000)
    bad = steps = 0
    for _ in range(3000):
        lost = False
        for risk, n in zip(risks, sizes, strict=True):
            drawn = rng.multinomial(n, [*risk, 1 - risk.sum()])
            k = quality.certify(drawn[:-1].tolist(), n, alpha, delta / strata)
            steps += k
            lost |= risk[:k].sum() > alpha
        bad += lost
    assert bad <= delta * 3000 and steps > 3000


def plain_signals(text):
    words, chars, symbols, dup, repeated = brute(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters, upper = len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text))
    share = lambda a, b: min(1.0, a / b) if b else 0.0
    return [share(symbols, chars), share(dup, len(lines)), share(repeated, words), share(upper, letters), share(text.count("!"), words)]


def brute_verdicts(docs, labels, alpha, delta, folds, grid):
    """doc_id to (base failed, kept), by plain loops over the labelled documents. folds: ids of the design."""
    base = {i: brute(t)[0] < 50 or 100 * brute(t)[4] > 50 * brute(t)[0] for i, t, _ in docs}
    values = {i: plain_signals(t) for i, t, _ in docs}
    lang = {i: l for i, _, l in docs}
    labelled = [i for i in labels if not base[i]]
    design = [i for i in labelled if i in folds]
    good, bad = [i for i in design if labels[i]], [i for i in design if not labels[i]]
    path, cuts = [], [2.0] * 5
    out = lambda i, cuts: any(v > c for v, c in zip(values[i], cuts))
    while True:
        options = []
        for k in range(5):
            for g in grid:
                new = [*cuts[:k], g, *cuts[k + 1 :]]
                if g < cuts[k] and any(out(i, new) and not out(i, cuts) for i in bad):
                    more = lambda ids: sum(out(i, new) and not out(i, cuts) for i in ids) / max(1, len(ids))
                    options.append((more(bad) - 5 * more(good), -k, new))
                    break
        if not options or max(options)[0] <= 0:
            break
        _, _, cuts = max(options, key=lambda o: o[:2])
        path.append(cuts)
    tested = [i for i in labelled if i not in folds and labels[i]]
    count = Counter(lang[i] for i in tested)
    need = lambda m: math.log(delta / m) / math.log(1 - alpha)
    order = sorted(count.values(), reverse=True)
    alone = max((k for k in range(1, len(order) + 1) if order[k - 1] >= need(k + 1)), default=0)
    own = {l for l, n in count.items() if alone and n >= order[alone - 1]}
    group = lambda l: l if l in own else "all others"
    rule = {}
    for g in {group(l) for l in count}:
        ids = [i for i in tested if group(lang[i]) == g]
        for cuts in path:
            k = sum(out(i, cuts) for i in ids)
            if sum(math.comb(len(ids), x) * alpha**x * (1 - alpha) ** (len(ids) - x) for x in range(k + 1)) > delta / (alone + 1):
                break
            rule[g] = cuts
    return {i: (base[i], not base[i] and not (lang[i] in count and group(lang[i]) in rule and out(i, rule[group(lang[i])]))) for i, _, _ in docs}


def test_verdicts_against_brute_force(spark):
    """Strata that stand alone, strata that are tested together, one without labels; bad documents of two kinds."""
    rng = random.Random(10)
    docs, labels = [], {}
    for i in range(3600):
        lang = rng.choice(["en"] * 6 + ["de"] * 3 + [None, "fr", "es", "it"])
        good = rng.random() < 0.8
        words = prose(rng, rng.choice((20, 60, 60, 60))).split()
        if not good:
            kind = rng.randrange(3)
            words = [w + "%" * rng.randint(0, 3) if kind == 0 else w.upper() if kind == 1 and rng.random() < 0.6 else w for w in words]
        elif rng.random() < 0.03:
            words[:3] = ["A!", "B!", "C!!"]
        docs.append((i, " ".join(words), lang))
        if lang != "it":
            labels[i] = int(good)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    folds = {r.doc_id for r in df.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.DESIGN_FOLDS)) == 0).collect()}
    for delta, least in ((0.05, 1), (0.5, 1)):
        got = quality.apply_rules(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), delta=delta).collect()
        want = brute_verdicts(docs, labels, 0.02, delta, folds, quality.GRID)
        assert {r.doc_id: (r.base_failed, r.kept) for r in got} == want
        assert sum(r.certified and not r.kept and not r.base_failed for r in got) > least
        assert {r.stratum for r in got if r.certified} >= {"en", "de"} and "it" not in {r.stratum for r in got if r.certified}
    # held by a shuffle join, the same
    again = quality.apply_rules(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), delta=delta, broadcast_strata=0).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in again} == want


def test_many_strata(spark):
    """Each of many strata is judged, alone or together with others: there is no most."""
    rng = random.Random(11)
    docs = [(i, prose(rng, 55) + (" %%%%%%" * 30 if i % 5 == 0 else ""), f"l{i % 400}") for i in range(2400)]
    labels = [(i, int(i % 5 > 0)) for i in range(2400)]
    got = quality.apply_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id % 5 > 0) and r.certified for r in got)


def test_edges(spark, edges, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.apply_rules(clashing(edges, "n_words", "stratum", "kept", "s", "good"), labels).collect()
    assert len(got) == 12 and all(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t) for r in got for t in [next(x.text for x in edges.collect() if x.doc_id == r.doc_id and brute(x.text)[0] == r.n_words)])
    assert quality.apply_rules(no_docs, labels).collect() == []
    assert {r.kept for r in quality.apply_rules(edges, labels.where("false")).collect()} == {True, False}


def test_path_from_every_label(spark):
    """The path comes from all labels of the design, however few rows the driver may hold: rare bad documents count too."""
    rng = random.Random(13)
    docs, labels = [], {}
    for i in range(2000):
        text = prose(rng, 60)
        kind = "symbols" if i % 10 == 0 else "capitals" if i % 50 == 7 else "marks" if i % 50 == 9 else None
        words = text.split()
        if kind:
            words[:30] = [{"symbols": w + "%%%", "capitals": w.upper(), "marks": w + "!"}[kind] for w in words[:30]]
        docs.append((i, " ".join(words), "en"))
        labels[i] = int(kind is None)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    given_labels = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    folds = {r.doc_id for r in df.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.DESIGN_FOLDS)) == 0).collect()}
    want = brute_verdicts(docs, labels, 0.02, 0.05, folds, quality.GRID)
    assert {i for i, (_, kept) in want.items() if not kept} == {i for i in labels if not labels[i]}
    for most in (20, 0, 20_000):  # more documents than the driver may hold, but few different ones; summed by the executors; all on the driver
        got = quality.apply_rules(df, given_labels, max_design=most).collect()
        assert {r.doc_id: (r.base_failed, r.kept) for r in got} == want, most


def test_design_here_and_there(spark):
    """The driver and the executors count the same, for every limit, and design the same path."""
    rng = np.random.default_rng(14)
    rows = [(*map(int, rng.integers(0, len(quality.GRID) + 1, 5) * (rng.random(5) < 0.3)), int(rng.random() < 0.8), int(rng.integers(1, 9))) for _ in range(300)]
    here, there = quality.tally_here(rows), quality.tally_there(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in (*quality.SIGNALS, "good")) + ", n long"))
    for limits in ([len(quality.GRID) + 1] * 5, [3, 20, 9, 1, 24], [0] * 5):
        assert (here(limits) == there(limits)).all()
    assert here([len(quality.GRID) + 1] * 5).sum() == 5 * sum(r[-1] for r in rows)
    assert quality.design(here) == quality.design(there)
    assert quality.design(quality.tally_here([])) == []
    # one bad document that no good one resembles adds a step, among however many
    path = quality.design(quality.tally_here([(0, 0, 0, 0, 0, 1, 10**9), (5, 0, 0, 0, 0, 0, 10**6), (0, 0, 0, 0, 2, 0, 1)]))
    assert path == [(0, len(quality.GRID) - 5), (4, len(quality.GRID) - 2)]
