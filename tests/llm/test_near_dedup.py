import random
import re

import numpy as np
import pytest

from scriptorium.llm import near_dedup
from scriptorium.llm._shared import Scratch
from tests.llm.conftest import clashing, prose


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(docs, n):
    """doc_id to (set size, smallest linked identifier); rows that share an identifier are one document."""
    sets = {}
    top = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t, n))
        top[i] = i

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng, text, share):
    return " ".join("".join(rng.choice("xyz") for _ in range(4)) if rng.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("n", [2, 5])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    docs = []
    for g in range(14):
        base = prose(rng, rng.choice((6, 30, 120, 300)))
        docs += [edited(rng, base, rng.choice((0, 0.01, 0.02, 0.04, 0.08))) for _ in range(rng.choice((1, 3, 12, 40)))]
    docs += [prose(rng, 1), "a", "a", "a b", "B a", "a  B", "", " ", prose(rng, 60)]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle_words=n).collect()
    want = brute(rows, n)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingles(docs[r.doc_id], n)) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_bridge_in_one_bucket(spark):
    """A leader that is far from the others must not hide their links: chains of borderline pairs."""
    rng = random.Random(21)
    words = prose(rng, 200).split()
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        for _ in range(7):
            words[rng.randrange(200)] = "".join(rng.choice("xyzuvw") for _ in range(5))
    rng.shuffle(rows)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 2)


def chained(rng, n, words=120, changes=4):
    """Texts of which only neighbours reach the threshold."""
    now = prose(rng, words).split()
    out = []
    for _ in range(n):
        out.append(" ".join(now))
        for _ in range(changes):
            now[rng.randrange(words)] = "".join(rng.choice("xyzuvw") for _ in range(5))
    return out


@pytest.mark.parametrize("settings", [{}, {"BROADCAST_IDS": 0}, {"HOT": 3, "REMEMBERED": 1}, {"HOT": 3, "BROADCAST_IDS": 0}])
def test_many_blocks(spark, monkeypatch, settings):
    """Buckets of many small blocks, joins by shuffle, salted leaders: all the same components."""
    for name, value in settings.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(26)
    docs = [*chained(rng, 40), *chained(rng, 25, 60, 2), *([prose(rng, 50)] * 7)]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    for n in (2, 5):
        got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle_words=n, block=3).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(rows, n)


def test_nothing_is_left_but_two_tables(spark, tmp_path, monkeypatch):
    """Intermediate tables go with their last reader."""
    from scriptorium.llm import _shared

    monkeypatch.setattr(_shared, "scratch_path", lambda spark, label: str(tmp_path / label))
    rng = random.Random(27)
    rows = list(enumerate(chained(rng, 30)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2, block=3)
    assert len(list((tmp_path / "near-dedup").iterdir())) == 2 and got.count() == 30


def test_small_batches():
    """Workers take, and give back, few rows at a time: all of them, in order."""
    import pyarrow as pa

    from scriptorium.llm import _shared

    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 3000), (3000, 3000), (3000, 3001))]
    got = list(_shared.slices(batches))
    assert max(b.num_rows for b in got) == _shared.SLICE and [x for b in got for x in b.column(0).to_pylist()] == list(range(3001))


def test_components(spark):
    rng = random.Random(22)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(200)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_posterior_bound():
    for n in (32, 160):
        m = near_dedup.least_matches(n, 0.8, 1e-6)
        grid = np.linspace(0, 1, 200_001)[1:-1]
        for k, below in ((m, False), (m - 1, True)):
            density = k * np.log(grid) + (n - k) * np.log1p(-grid)
            density = np.exp(density - density.max())
            assert (density[grid >= 0.8].sum() / density.sum() < 1e-6) == below


def test_edges(spark, edges, no_docs):
    got = near_dedup.near_dedup(clashing(edges, "node", "component", "digest", "kept", "a", "key"), shingle_words=2).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.kept for r in by[4]] == [True, True] and by[5][0].component_id == 4 and not by[5][0].kept
    assert all(by[i][0].kept and by[i][0].n_shingles == 0 for i in (1, 2, 3))
    # without an identifier: the smallest one of the same set, or none
    assert sorted((r.component_id is None, r.kept) for r in by[None]) == [(False, False), (True, True)]
    assert near_dedup.near_dedup(no_docs).collect() == []
