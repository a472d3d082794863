import random

from scriptorium.llm import language
from tests.llm.conftest import clashing, prose


def test_accuracy_and_fold(spark):
    rng = random.Random(7)
    tongues = {"aa": "aeioubcd", "bb": "xyzwvkqj", "cc": "äöüßmnop"}
    rows = [(i, prose(rng, rng.randint(3, 80), tongues[l]), l) for i in range(600) for l in [rng.choice(sorted(tongues))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df).join(df, "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)


def test_held_out_documents(spark):
    """The documents of the held-out fold, which no model sees."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_unlearned_texts_are_rejected(spark):
    """Texts of an unlearned language and letter noise go, texts of the learned ones stay."""
    model = language.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        "xqzj kvwp qqxz vbkj wpfj zzxq jkvq xwzk qjvx kzzp",
    ]
    assert [x for x in strange if not model.predict(x)[2]] == []
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert sum(model.predict(r.text)[2] for r in rows) <= 0.005 * len(rows)


def test_thresholds_by_length():
    """Each class has its own quantile, which at least the tenth lowest example sets."""
    import numpy as np

    rng = np.random.default_rng(4)
    sizes = np.repeat([10, 100, 1000], [2000, 2000, 500])
    values = rng.normal(0, 1, len(sizes)) - np.where(sizes == 10, 5, 0)
    model = language.Model(["a"], np.zeros((2, 1), np.float32), np.zeros(1, np.float32), 1.0, np.zeros((1, 2), np.float32))
    model.calibrate(sizes, values, 0.01)
    assert list(model.starts) == [0, 32]
    assert list(model.thresholds) == [np.sort(values[sizes == 10])[19], np.sort(values[sizes > 10])[24]]


def test_held_out_labels_are_not_read(spark):
    import zlib

    rng = random.Random(8)
    rows = [(i, prose(rng, 20), "en") for i in range(100)]
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else l) for i, t, l in rows]
    a, b = (language.identify(spark.createDataFrame(r, "doc_id long, text string, lang string").coalesce(1)).orderBy("doc_id").collect() for r in (rows, other))
    assert a == b and {r.lang_pred for r in a} == {"en"}


def test_edges(spark, edges, no_docs):
    got = language.identify(clashing(edges, "score", "lang_pred", "held_out", "draw", "chance", "ids")).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got if r.doc_id}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3, 9))
    assert by[4].lang_pred in ("en", "de") and by[8].lang_pred in ("en", "de")
    assert language.identify(no_docs).collect() == []
    nothing = language.identify(edges.withColumn("lang", edges.lang.substr(9, 1)).where("false").unionByName(edges.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
