import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_words(spark):
    assert one(spark, "Self-Attention, 3D naïve U2", T.words) == ["self", "attention", "3d", "na", "ve", "u2"]
    assert one(spark, "", T.words) == []


def test_terms(spark):
    assert one(spark, "The use of others' caches and a B tree", T.terms) == ["other", "cach", "tree"]


@pytest.mark.parametrize(
    "word, stem",
    [("rivers", "river"), ("queries", "query"), ("classes", "class"), ("boxes", "box"), ("ties", "tie"), ("bias", "bias"), ("lens", "lens"), ("glass", "glass"), ("status", "status"), ("basis", "basis"), ("gas", "gas"),
     ("matrices", "matrix"), ("analyses", "analysis"), ("sizes", "siz"), ("size", "size"), ("news", "new"), ("series", "sery"), ("buses", "buse")],
)
def test_stem(spark, word, stem):
    assert one(spark, word, T.stem) == stem


def test_clean(spark):
    assert one(spark, "  a \n\t b c \x1f", T.clean) == "a b c"


@pytest.mark.parametrize("identifier, month", [("2405.01234", "2024-05"), ("0704.0001v2", "2007-04"), ("cs/0501001", "2005-01"), ("quant-ph/9912123", "1999-12"), ("math.GT/0309136", "2003-09"), ("nothing", "0000-00")])
def test_published_month(spark, identifier, month):
    assert one(spark, identifier, T.published_month) == month


def test_title_phrases(spark):
    assert one(spark, "the theory of graphs via new trees".split(), T.title_phrases, "array<string>") == ["theory of graphs"]
    assert one(spark, "deep river models".split(), T.title_phrases, "array<string>") == ["deep river", "river models", "deep river models"]
    assert one(spark, ["x"], T.title_phrases, "array<string>") == []
    assert one(spark, [], T.title_phrases, "array<string>") == []


def osa(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not (i and j)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(7)))
    pairs = [("ca", "abc"), ("", ""), ("", "abc"), ("abc", ""), ("neural", "nueral"), ("kitten", "sitting"), *((word(), word()) for _ in range(200))]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in rows] == [osa(r.a, r.b) for r in rows]
    assert rows[0].d == 3


def marks(spark, text, terms, **k):
    f = (lambda t: T.snippet(t, terms, **k)["pieces"]) if k else (lambda t: T.highlight(t, terms))
    got = [(p.text, p.hit) for p in one(spark, text, f)]
    assert got == [(p["text"], p["hit"]) for p in T.plain_highlight(text, terms, **k)]
    return got


def test_highlight(spark):
    assert marks(spark, "Big Rivers, rivers and seas.", ["river"]) == [("Big ", False), ("Rivers", True), (", ", False), ("rivers", True), (" and seas.", False)]
    assert marks(spark, "", ["river"]) == []
    assert marks(spark, "...", ["river"]) == [("...", False)]
    assert marks(spark, "none here", ["river"]) == [("none here", False)]


def test_snippet(spark):
    text = " ".join(f"w{i}" for i in range(30)) + " river delta river " + " ".join(f"v{i}" for i in range(30))
    got = marks(spark, text, ["river", "delta"], max_words=10)
    assert got[0] == ("... ", False) and got[-1] == (" ...", False)
    assert sum(h for _, h in got) == 3
    assert marks(spark, "short text", ["text"], max_words=10) == [("short ", False), ("text", True)]
    assert marks(spark, "", ["text"], max_words=10) == []


def test_window_start(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(2) if rng.random() < 0.5 else 0 for _ in range(rng.randrange(30))] for _ in range(200)]
    places = [([i for i, h in enumerate(x) if h], len(x)) for x in lists]
    rows = spark.createDataFrame(places, "p array<int>, n int").select(T.window_start(F.col("p"), F.col("n"), 5).alias("y")).collect()
    for x, r in zip(lists, rows, strict=True):
        starts = range(max(1, len(x) - 4))
        assert r.y == max(starts, key=lambda s: (sum(x[s : s + 5]), -s))


def test_snippets_of_random_texts(spark):
    """Columns and driver agree, with text before the first word and behind the last."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(("river ", "Rivers, ", "delta", " sea ", "-- ", "x", "ß ")) for _ in range(rng.randrange(40))) for _ in range(150)]
    terms = ["river", "delta", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.highlight(F.col("t"), terms).alias("h"), T.snippet(F.col("t"), terms, 7).alias("s")).collect()
    for r in rows:
        assert [p.asDict() for p in r.h] == T.plain_highlight(r.t, terms) and [p.asDict() for p in r.s["pieces"]] == T.plain_highlight(r.t, terms, 7)


def test_surface_forms():
    """Every word that has one of the stems, and no other."""
    stems = ["bias", "city", "class", "index", "river", "siz", "tie", "us"]
    words = {w + e for w in ("bias", "cit", "class", "index", "indic", "river", "siz", "tie", "us", "t") for e in ("", "s", "es", "ies", "y", "ses")}
    assert set(T.surface_forms(stems)) & words == {w for w in words if T.plain_stem(w) in stems}
    assert T.surface_forms([]) == []


def test_plain_forms(spark):
    rng = random.Random(23)
    ends = ("", "s", "es", "ies", "sses", "xes", "ches", "shes", "zes", "ss", "us", "is")
    words = [*T.IRREGULAR, *T.UNCHANGED, *T.STOPWORDS, *("".join(rng.choice("abchsxz") for _ in range(rng.randint(1, 4))) + rng.choice(ends) for _ in range(500))]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s"), T.is_content_word(F.col("w")).alias("c")).collect()
    assert all((T.plain_stem(r.w), T.plain_content_word(r.w)) == (r.s, r.c) for r in rows)
    assert one(spark, "Self-Attention, 3D na\u00efve", T.words) == T.plain_words("Self-Attention, 3D na\u00efve")


def test_rules_end_in_s():
    """The stemmer passes by words that do not end in s, so every rule and exception must be for such words."""
    assert all(word.endswith("s") for word in (*T.IRREGULAR, *T.UNCHANGED))
    assert [T.plain_stem(w) for w in ("index", "rivers", "boxes", "glass", "river")] == ["index", "river", "box", "glass", "river"]


def test_phrases_by_brute_force(spark):
    """Edges are judged once per word: as many evaluations as words, and the phrases of the definition."""
    rng, words = random.Random(5), ("deep", "river", "of", "via", "x", "new", "models", "a", "stone", "up")
    titles = [None, "", "deep", "deep river", *(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(60))]
    edge = lambda w: T.plain_content_word(w) and w not in T.WEAK_EDGES

    def brute(title):
        w = T.plain_words(title or "")
        grams = [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]
        return [" ".join(g) for g in grams if edge(g[0]) and edge(g[-1]) and min(map(len, g)) > 1]

    df = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    made = df.select("i", T.title_phrases(T.words(F.col("t"))).alias("p"))
    assert {r.i: r.p or [] for r in made.collect()} == {i: brute(t) for i, t in enumerate(titles)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" IN ") + plan.count("INSET") <= 2
