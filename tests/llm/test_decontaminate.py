import hashlib
import random
import re

from scriptorium.llm import decontaminate
from tests.llm.conftest import clashing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit.update(range(j, j + m))
                    names.add(str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def case():
    rng = random.Random(17)
    draw = lambda n, k: " ".join(rng.choice("abcdefg"[:k]) for _ in range(n))
    items = [(i, draw(rng.choice((1, 2, 3, 9, 10, 14)), 7)) for i in range(3, 40)] + [(40, ""), (40, "ÉTÉ x"), (100, draw(12, 2))]
    docs = [(i, draw(rng.randint(0, 60), rng.choice((2, 7))) + rng.choice(("", " été-X!", " " + rng.choice(items)[1]))) for i in range(150)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    want = {i: brute(t, items) for i, t in docs}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for k in ({}, {"block_words": 20}, {"block_words": 20, "broadcast_hits": 0}):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(decontaminate.decontaminate(df, bench, **k)).collect()}
        assert got == want
        assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench, **k).collect()} == {i for i, w in want.items() if not w[-1]}


def test_tables_are_built_once_a_task(spark, tmp_path, monkeypatch):
    """With many blocks each partition has the tables of each block built once, however many batches it has."""
    docs, items = case()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    original, log = decontaminate.searchers, str(tmp_path)

    def logged(block, window):
        import uuid
        from pathlib import Path

        from pyspark import TaskContext

        Path(log, f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}").touch()
        return original(block, window)

    monkeypatch.setattr(decontaminate, "searchers", logged)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        blocks = len(decontaminate.ship(bench, 20, "item_id", "text"))
        assert decontaminate.decontaminate(df, bench, block_words=20).count() == len(docs) and blocks >= 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(list(tmp_path.iterdir())) == 3 * blocks


def test_edges(spark, edges, no_docs):
    bench = spark.createDataFrame([(1, None), (None, "word"), (2, "Ünïcode SS"), (3, "word")], "item_id long, text string")
    got = decontaminate.digest(decontaminate.decontaminate(clashing(edges, "items", "n_hit"), bench)).collect()
    items = [(3, "word"), (2, "Ünïcode SS")]
    texts = {r.doc_id: r.text for r in edges.collect() if r.doc_id}
    assert len(got) == 12 and all(tuple(r)[1:] == brute(texts[r.doc_id], items) for r in got if r.doc_id)
    assert decontaminate.decontaminate(no_docs, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.decontaminate(edges, bench.where("false"))).collect())
    kept = decontaminate.drop_contaminated(clashing(edges, "items"), bench)
    assert kept.columns == [*edges.columns, "items"] and kept.count() == 11
