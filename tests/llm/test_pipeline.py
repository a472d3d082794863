import inspect
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from scriptorium.llm._shared import Scratch
from tests.llm.conftest import clashing
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_packing import check as check_packed
from tests.llm.test_decontaminate import brute as contamination
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).parent


def test_stages(spark):
    """Every stage on its own input, held against brute force."""
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(scratch.keep(stage(spark, steps[-1], DATA)))
    assert all(s.columns == columns for s in steps[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:-1]]
    # language: only texts without a letter, or far from every language, go
    assert len(rows[1]) >= 0.99 * len(rows[0]) and all(rows[1][i] == rows[0][i] for i in rows[1])
    # near duplicates: one of each group
    top = components([(i, r.text) for i, r in rows[1].items()], 5)
    assert set(rows[2]) == {i for i, c in top.items() if i == c} and len(rows[2]) < len(rows[1])
    # benchmark
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert set(rows[3]) == {i for i, r in rows[2].items() if not contamination(r.text, items)[-1]}
    # secrets: all rows stay
    assert set(rows[4]) == set(rows[3]) and all(r.n_chars == len(r.text) for r in rows[4].values())
    # packing
    check_packed(steps[-1].withColumn("ids_crc32", F.crc32("ids")).collect(), [(i, r.text) for i, r in rows[4].items()])


#: Names that any stage gives to columns of its own, and names that need quoting.
NAMES = (
    "lang_pred rejected score draw chance extra size familiarity held_out component component_id kept kept_id _kept_id times row node digest signature keys key a b sa sb leader n n_shingles"
    " _language_rejected _language_score _language_lang_pred items spans n_hit n_words kind start end prompt ids length doc_tokens loss_tokens sequence_id offset matches text_ doc_id_ word max min"
).split()


def test_edges(spark, edges, no_docs):
    """Nulls, empty and very long texts, repeated rows, clashing and odd names: no column or value changes but text and length."""
    odd = clashing(edges, *NAMES, "a`b", "a.b", "two words", "`").withColumn("nested", F.struct(F.array("doc_id").alias("x")))
    for docs in (no_docs, odd):
        out = docs
        before = {(r.doc_id, r.text): r for r in docs.collect()}
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, DATA)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            rows = out.collect()
            for r in rows:
                was = before[r.doc_id, r.text]
                assert r.n_chars in (was.n_chars, len(r.text)) and r.asDict() | {"n_chars": 0} == was.asDict() | {"n_chars": 0}
        assert corpus_pipeline.STAGES[-1][1](spark, out, DATA).count() >= len(rows)
    assert {r.doc_id for r in rows} == {None, 4, 6, 7, 8} and sum(r.doc_id == 4 for r in rows) == 1


def test_rows_that_share_an_identifier(spark):
    """Different texts under one identifier all stay, repeated rows do not."""
    a, b, c = ("one two three four five six seven", "red green blue black white grey pink", "up down left right in out over")
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (2, c), (3, c)], "doc_id long, text string")
    got = corpus_pipeline.deduplicate(spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (1, b), (2, c)])
    # of rows equal in identifier and text the first by its other columns
    docs = spark.createDataFrame([(1, a, "y"), (1, a, "x"), (1, b, None), (None, a, "z"), (None, a, "z")], "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.deduplicate(spark, docs, DATA).collect()
    assert sorted((str(r.doc_id), r.text, str(r.source)) for r in got) == sorted([("1", a, "x"), ("1", b, "None"), ("None", a, "z"), ("None", a, "z")])


def test_repeated_rows_beside_a_kept_text(spark):
    """An identifier's rows stay if one of its texts is kept, and repeated ones are one, whichever text that is."""
    a, c = "one two three four five six seven", "up down left right in out over"
    docs = spark.createDataFrame([(1, a), (3, a), (3, a), (3, c)], "doc_id long, text string")
    got = corpus_pipeline.deduplicate(spark, docs, DATA).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, a), (3, a), (3, c)])


def test_texts_are_not_shuffled_to_drop_duplicates(spark, monkeypatch):
    """While identifiers that go are few, they are broadcast; beyond that a join by a shuffle gives the same rows."""
    from scriptorium.llm import near_dedup

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        few = corpus_pipeline.deduplicate(spark, docs, DATA)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
        monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
        many = corpus_pipeline.deduplicate(spark, docs, DATA)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the entry module imports and lists the other queries."""
    import shutil

    for name in ("scriptorium", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rank_bm25_topk' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
