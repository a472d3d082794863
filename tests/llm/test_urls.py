import random

from scriptorium.llm import urls

SCHEMA = "page_id long, url string"


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, marks: s[: min((i for i, c in enumerate(s) if c in marks), default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def cases():
    rng = random.Random(13)
    hosts = ["com", "a.com", "EXAMPLE.com", "m.example.COM", "notexample.com", "example.net", "x.y.org", "org", "", "a..net", "com.", "é.com", "h:80.com", "u@b.org"]
    paths = ["", "/en/", "/en/7", "/en/70/x", "/en", "/EN/", "/de/8", "/de/", "/es/", "//en/", "/en/\n7"]
    tails = ["", "?q=/en/", "#/de/", "?a#b"]
    return [f"{rng.choice(('http', 'https', ''))}://{h}{p}{t}" for h in hosts for p in paths for t in tails] + ["no scheme", "", None, "://", "a://b://c/en/", "x" * 100_000 + "://example.com/en/7"]


def judged(spark, rules, **k):
    df = spark.createDataFrame(list(enumerate(cases())), SCHEMA)
    return {r.page_id: tuple(r)[1:] for r in urls.judge(df, urls.rule_table(spark, rules), **k).collect()}


def test_against_brute_force(spark):
    want = {i: brute(u, urls.RULES) for i, u in enumerate(cases())}
    for k in ({}, {"broadcast_rules": 0}, {"prefix_hex": 1}):
        assert judged(spark, urls.RULES, **k) == want
    short = [i for i, u in enumerate(cases()) if not u or len(u) < 1000]
    many = [*urls.RULES, *((f"h{i}.com", "/" + "x" * i, "block") for i in range(30))]
    got = judged(spark, many, inline_shapes=5)
    assert all(got[i] == want[i] for i in short)


def test_precedence(spark):
    rules = [("com", "/abc", "block"), ("a.com", "/ab", "allow"), ("a.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block")]
    df = spark.createDataFrame([(1, "x://a.com/abc"), (2, "x://a.com/z"), (3, "x://b.com/abcd")], SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, urls.rule_table(spark, rules)).collect()}
    # the third: same length, the longer host decides; the second: same rule twice, block before allow
    assert got == {1: ("a.com/ab", "allow") if len("a.com/ab") > len("com/abc") else ("com/abc", "block"), 2: ("a.com/", "block"), 3: ("com/abc", "block")}


def test_edges(spark):
    df = spark.createDataFrame([(None, "x://a.com/en/"), (1, None), (1, "x://a.com/en/"), (1, "x://a.com/en/")], SCHEMA).selectExpr("*", "1 host", "2 path", "3 row", "4 prefix")
    got = urls.judge(df, urls.rule_table(spark)).collect()
    assert len(got) == 4 and sum(r.verdict == "block" for r in got) == 3
    assert urls.judge(df.where("false"), urls.rule_table(spark)).collect() == []
    assert {r.verdict for r in urls.judge(df, urls.rule_table(spark).where("false")).collect()} == {"allow"}


def test_rules_of_the_contract(spark):
    """Each rule's word, literally: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    want = {
        "x://com/en/": ("com/en/", "block"),
        "x://www.example.com/en/70": ("example.com/en/7", "allow"),
        "x://other.net/de/8": ("net/de/", "allow"),
        "x://example.net/de/7": ("net/de/", "allow"),
        "x://m.example.net/de/80": ("example.net/de/8", "block"),
        "x://a.org/es/": ("org/es/", "block"),
        "x://a.org/de/": (None, "allow"),
    }
    df = spark.createDataFrame(list(enumerate(want)), SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, urls.rule_table(spark)).collect()}
    assert got == dict(enumerate(want.values()))
