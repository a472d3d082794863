import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from scriptorium import api, bootstrap
from scriptorium.config import Settings
from scriptorium.operators import evaluation
from scriptorium.sources import records
from scriptorium.sources.store import Store
from tests.conftest import PAPERS


def test_normalise(spark, papers):
    rows = {r.arxiv_id: r for r in records.normalise(papers).collect()}
    assert rows["2404.00044"].authors == "Eve Hill, Flo Wood, Gus Lake" and rows["2403.00033"].authors == "Dan Field"
    assert rows["2401.00011"].primary_category == "cs.CL" and rows["cs/9901012"].published == "1999-01"
    bare = records.normalise(spark.createDataFrame([("x", " a\n b ", "c", None, None)], records.RECORD)).first()
    assert (bare.title, bare.authors, bare.categories, bare.primary_category) == ("a b", "", "", "unknown")


def test_jsonl_fails_on_a_bad_line(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_jsonl_round_trip(spark, papers, tmp_path):
    records.write_jsonl(papers, str(tmp_path / "out"))
    assert records.read_jsonl(spark, str(tmp_path / "out")).count() == 6


def test_store(spark, store, papers):
    assert store.add(papers) == 0 and store.count() == 6
    assert [r.id for r in store.page(0, 4).collect()] == [1, 2, 3, 4] and [r.id for r in store.page(4, 4).collect()] == [5, 6]
    assert [r.arxiv_id for r in store.documents()] == [p["id"] for p in PAPERS]
    assert {r.id for r in store.get([2, 5, 77]).collect()} == {2, 5} and store.get([]).collect() == []
    assert [r.id for r in store.naive_search(["RIVER", "ston"]).collect()] == [3] and store.naive_search([]).collect() == []


def test_duplicates_and_missing_fields(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = [("1", "t", "a", "x", "c"), ("1", "later", "a", "x", "c"), ("2", "", "a", "x", "c"), ("3", "t", None, "x", "c"), ("4", " ", "a", "x", "c")]
    assert s.add(spark.createDataFrame(rows, records.RECORD).coalesce(1)) == 2
    assert {(r.arxiv_id, r.title) for r in s.rows().collect()} == {("1", "t"), ("4", "")}


PAGE = """<?xml version="1.0"?><OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>
<record><header status="deleted"><identifier>x</identifier></header></record>
<record><header><identifier>y</identifier></header><metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id>2401.1</id>
<authors><author><keyname>Brook</keyname><forenames>Ana</forenames></author><author><keyname>Stone</keyname></author></authors>
<title>A
  title</title><categories>cs.CL cs.LG</categories><abstract> Some
 text </abstract></arXiv></metadata></record>
<resumptionToken>next-1</resumptionToken></ListRecords></OAI-PMH>"""


def test_oai(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAGE)
    row = records.read_oai(spark, str(tmp_path / "p.xml")).collect()
    assert [(r.id, r.title, r.abstract, r.authors, r.categories) for r in row] == [("2401.1", "A title", "Some text", ["Ana Brook", "Stone"], "cs.CL cs.LG")]
    assert records.oai_control(spark, str(tmp_path / "p.xml")).first().token == "next-1"
    (tmp_path / "e.xml").write_text('<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><error code="badArgument">no</error></OAI-PMH>')
    with pytest.raises(ValueError):
        records.check_oai(records.oai_control(spark, str(tmp_path / "e.xml")))


def test_fetch_and_harvest():
    waits, answers = [], [urllib.error.HTTPError("u", 503, "busy", {"Retry-After": "7"}, None), urllib.error.HTTPError("u", 429, "busy", {}, None), io.BytesIO(b"ok")]

    def opener(url):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert records.fetch("u", opener=opener, sleep=waits.append) == b"ok" and waits == [7.0, 20.0]
    answers[:] = [urllib.error.HTTPError("u", 404, "gone", {}, None)]
    with pytest.raises(urllib.error.HTTPError):
        records.fetch("u", opener=opener, sleep=waits.append)
    tokens = ["a", ""]
    urls = []
    pages = list(records.harvest_pages("http://x", {"set": "cs"}, lambda _: tokens.pop(0), lambda u: urls.append(u) or b"p", sleep=lambda _: None))
    assert len(pages) == 2 and "set=cs" in urls[0] and "resumptionToken=a" in urls[1]


def test_percentiles(spark):
    values = [5, 1, 4, 2, 3, 9]
    rows = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    got = evaluation.percentiles_by(rows, "g", "v", {"a": 0.5, "b": 0.95, "c": 0.0}).first()
    assert (got.a, got.b, got.c) == tuple(evaluation.nearest_rank(values, f) for f in (0.5, 0.95, 0.0))
    assert evaluation.summarise([])["mean"] is None and evaluation.summarise([1, 2, 4])["median"] == 2


def test_known_item(spark, engine):
    from pyspark.sql import functions as F

    corpus = engine.store.select("id", "title", "abstract", F.col("primary_category").alias("category"))
    rows = {r["mode"]: r for r in evaluation.known_item(corpus).collect()}
    assert set(rows) == {"bm25", "tf", "match"} and rows["bm25"].recall_10 == 1.0


def test_api(spark, engine):
    get = lambda url: (lambda s, k, b: (s, json.loads(b) if "json" in k else b))(*api.respond(engine, url))
    assert get("/health") == (200, {"status": "ok", "documents": 6})
    status, body = get("/api/search?q=river&limit=1")
    assert status == 200 and body["total"] == 2 and len(body["results"]) == 1
    assert get("/api/suggest?q=ri")[1]["query"] == "ri"
    assert len(get("/api/categories")[1]["categories"]) == 6 and {"name": "cs.DB", "papers": 1} in get("/api/categories")[1]["categories"] and get("/api/stats")[1]["documents"] == 6
    assert b"<html" in get("/")[1] and get("/none")[0] == 404
    for bad in ("/api/search", "/api/search?q=", "/api/search?q=x&limit=500", "/api/search?q=" + "a" * 300, "/api/search?q=x&offset=-1", "/api/suggest?q=", "/api/search?q=x&correct=maybe", "/api/search?q=x&limit=%C2%B2", "/api/search?q=x&limit=--5", "/api/search?q=x&limit=", "/api/search?q=x&offset=99999999999999"):
        assert get(bad)[0] == 422, bad
    with api.server(engine, port=0) as s:
        threading.Thread(target=s.handle_request, daemon=True).start()
        assert json.load(urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/health"))["status"] == "ok"


def test_prepare(spark, tmp_path):
    sample = tmp_path / "s.jsonl"
    sample.write_text("\n".join(json.dumps(p) for p in PAPERS))
    settings = Settings(str(tmp_path / "store"), str(tmp_path / "index"), str(sample))
    assert bootstrap.prepare(spark, settings).stats()["documents"] == 6
    said = []
    assert bootstrap.prepare(spark, settings, said.append).search("river")["total"] == 2 and said == ["6 papers indexed"]


def test_harvest_to_a_file(spark, tmp_path):
    """Pages are followed to the end or to the most records, which are written once each."""
    second = PAGE.replace("2401.1", "2401.2").replace("next-1", "")
    answers = {"set=cs": PAGE, "resumptionToken=next-1": second}
    urls = []

    def get(url):
        urls.append(url)
        return next(body for part, body in answers.items() if part in url).encode()

    said = []
    out = tmp_path / "all.jsonl"
    n = records.harvest(str(out), "cs", first="2024-01-01", get=get, sleep=lambda _: None, log=said.append)
    rows = records.read_jsonl(spark, str(out)).collect()
    assert n == 2 and [r.id for r in rows] == ["2401.1", "2401.2"] and len(urls) == 2 and "from=2024-01-01" in urls[0]
    assert records.normalise(records.read_jsonl(spark, str(out))).first().authors == "Ana Brook, Stone" and said == ["1 records harvested", "2 records harvested"]
    assert records.harvest(str(tmp_path / "one.jsonl"), "cs", most=1, get=get, sleep=lambda _: None) == 1
    with pytest.raises(ValueError):
        records.page_records(b'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><error code="badArgument">no</error></OAI-PMH>')
    assert records.page_records(b'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><error code="noRecordsMatch"/></OAI-PMH>') == ([], None)


def test_database_store(spark, papers):
    """The store in a database by its URL."""
    kept = Store(spark, "jdbc:derby:memory:papers;create=true")
    assert kept.count() == 0 and kept.add(papers) == 6 and kept.add(papers) == 0
    again = Store(spark, "jdbc:derby:memory:papers")
    assert again.count() == 6 and [r.arxiv_id for r in again.documents()] == [p["id"] for p in PAPERS]
    assert {r.id for r in again.get([2, 5, 77]).collect()} == {2, 5} and [r.id for r in again.naive_search(["RIVER", "ston"]).collect()] == [3]


def test_bench_report(spark, store, engine):
    from scriptorium import cli

    result = cli.bench(engine, store, 3, 2)
    assert set(result) == {"documents", "terms", "postings", "build_seconds", "index_megabytes", "queries", "engine_ms", "baseline_queries", "baseline_ms", "database"}
    lines = cli.bench_lines(result)
    assert lines[0].startswith("6 documents") and len(lines) == 4 and result["database"] == "parquet"


def test_evaluation_report(spark, store):
    from scriptorium import cli

    result = cli.evaluate(store.rows(), 4)
    assert result["queries"] == 4 and result["documents"] == 6 and set(result["modes"]) == {"bm25", "tf", "match"}
    assert "4 queries over 6 abstracts" in cli.evaluation_lines(result)[0]


def test_known_item_scores_the_rest_only_for_open_queries(spark, monkeypatch):
    """Queries that the first documents show to be misses are not scored on the others, with the results of scoring all."""
    import duckdb

    from scriptorium.plans import oracles, queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{data}/documents.parquet'")
    want = sorted(con.sql(oracles.ORACLE_SQL["known_item_eval"]).fetchall())
    for first in (10, 60, 1000):
        monkeypatch.setattr(evaluation, "FIRST_DOCS", first)
        assert sorted(map(tuple, queries.known_item_eval(spark, data).collect())) == want


def test_known_item_edges(spark):
    """Null and empty texts, titles without terms in any abstract, and no documents at all."""
    rows = [(1, "Rivers of stone", "stone river"), (2, "", "river"), (3, None, None), (4, "absent words", None)]
    corpus = spark.createDataFrame([(*r, "c") for r in rows], "id long, title string, abstract string, category string")
    got = {r["mode"]: (r.recall_1, r.recall_10, r.mrr_10) for r in evaluation.known_item(corpus).collect()}
    assert got == dict.fromkeys(("bm25", "tf", "match"), (0.25, 0.25, 0.25))
    assert evaluation.known_item(corpus.where("false")).collect() == []
