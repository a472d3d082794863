"""Command line: harvest, ingest, index, search, suggest, stats, serve, bench, evaluate."""

from __future__ import annotations

import argparse
import json
import sys

from .bootstrap import prepare
from .config import Settings
from .functions import text as T
from .operators import evaluation
from .plans.engine import SearchEngine
from .session import session
from .sources.records import harvest, read_jsonl
from .sources.store import Store


def _plain(pieces: list[dict]) -> str:
    return "".join(f"*{p['text']}*" if p["hit"] else p["text"] for p in pieces)


def bench(engine: SearchEngine, store: Store, queries: int = 300, baseline_queries: int = 30) -> dict:
    """Times of whole searches and of the substring scan for the same queries, with the facts of the index."""
    asked = evaluation.sample_queries(engine.corpus(engine.store), queries)
    scanned = asked[:baseline_queries]
    facts = engine.stats()
    return {
        **{k: facts[k] for k in ("documents", "terms", "postings", "build_seconds")},
        "index_megabytes": engine.megabytes(),
        "queries": len(asked),
        "engine_ms": evaluation.timed([lambda q=q: engine.search(q) for q in asked]),
        "baseline_queries": len(scanned),
        "baseline_ms": evaluation.timed([lambda q=q: store.naive_search(list(filter(T.plain_content_word, T.plain_words(q)))).collect() for q in scanned]),
        "database": store.kind,
    }


def bench_lines(r: dict) -> list[str]:
    times = lambda t, *which: ", ".join(f"{name} {t[name]} ms" for name in which)
    return [
        f"{r['documents']} documents, {r['terms']} terms, {r['postings']} postings",
        f"Index: built in {r['build_seconds']} s, {r['index_megabytes']} MB stored",
        f"Searches ({r['queries']}): {times(r['engine_ms'], 'median', 'p95', 'p99')}",
        f"Substring scans of the {r['database']} store ({r['baseline_queries']}): {times(r['baseline_ms'], 'median', 'p95')}",
    ]


def evaluate(rows, sample: int) -> dict:
    """Known-item evaluation with the numbers of queries and documents."""
    corpus = SearchEngine.corpus(rows)
    n = corpus.count()
    found = {r["mode"]: {"recall_at_1": r.recall_1, "recall_at_10": r.recall_10, "mrr_at_10": r.mrr_10} for r in evaluation.known_item(corpus, sample).collect()} if n else {}
    return {"queries": min(sample, n), "documents": n, "modes": found}


def evaluation_lines(result: dict) -> list[str]:
    labels = {"bm25": "BM25", "tf": "raw term counts", "match": "number of matching terms"}
    rows = [f"{label:26} recall@1 {m['recall_at_1']:.3f}  recall@10 {m['recall_at_10']:.3f}  MRR@10 {m['mrr_at_10']:.3f}" for mode, label in labels.items() if (m := result["modes"].get(mode))]
    return [f"Titles against abstracts: {result['queries']} queries over {result['documents']} abstracts", *rows]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scriptorium")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("path")
    commands.add_parser("index")
    p = commands.add_parser("search")
    p.add_argument("query")
    p.add_argument("--category")
    p.add_argument("--limit", type=int, default=10)
    commands.add_parser("suggest").add_argument("text")
    commands.add_parser("stats")
    p = commands.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p = commands.add_parser("bench")
    p.add_argument("--queries", type=int, default=300)
    p.add_argument("--baseline-queries", type=int, default=30)
    p.add_argument("--json", action="store_true")
    p = commands.add_parser("evaluate")
    p.add_argument("--sample", type=int, default=1000)
    p.add_argument("--json", action="store_true")
    p = commands.add_parser("harvest")
    p.add_argument("--out", required=True)
    p.add_argument("--set", default="cs", dest="set_name")
    p.add_argument("--from", dest="first")
    p.add_argument("--until")
    p.add_argument("--max", type=int, default=100_000, dest="most")
    args = parser.parse_args(argv)
    if args.command == "harvest":
        n = harvest(args.out, args.set_name, args.first, args.until, args.most, log=lambda text: print(text, file=sys.stderr))
        print(f"{n} records in {args.out}")
        return 0

    settings, spark = Settings.from_env(), session()
    store = Store(spark, settings.store_path)
    if args.command == "ingest":
        print(f"added {store.add(read_jsonl(spark, args.path))} papers")
        return 0
    if args.command == "index":
        print(json.dumps(SearchEngine.build(spark, store.rows()).save(settings.index_path).stats()))
        return 0
    if args.command == "evaluate":
        result = evaluate(store.rows(), args.sample)
        print(json.dumps(result, indent=2) if args.json else "\n".join(evaluation_lines(result)))
        return 0
    engine = prepare(spark, settings, lambda text: print(text, file=sys.stderr))
    if args.command == "search":
        found = engine.search(args.query, args.category, args.limit)
        if found["corrected_query"]:
            print(f"Showing results for {found['corrected_query']}")
        print(f"{found['total']} papers")
        for r in found["results"]:
            print(f"\n{_plain(r['title'])}\n  {r['url']}  {r['category']}  {r['published']}  {r['score']}\n  {_plain(r['snippet'])}")
    elif args.command == "suggest":
        print("\n".join(engine.suggest(args.text)))
    elif args.command == "stats":
        print(json.dumps(engine.stats(), indent=2))
    elif args.command == "bench":
        result = bench(engine, store, args.queries, args.baseline_queries)
        print(json.dumps(result, indent=2) if args.json else "\n".join(bench_lines(result)))
    else:
        from .api import server

        with server(engine, args.host, args.port) as s:
            print(f"http://{args.host}:{args.port}/", file=sys.stderr)
            s.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
