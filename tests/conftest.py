import pytest
from pyspark.sql import SparkSession

PAPERS = [
    {"id": "2401.00011", "title": "Sparse attention for long river models", "abstract": "We study attention models that read long rivers of text. The models use sparse gates.", "authors": ["Ana Brook", "Ben Stone"], "categories": "cs.CL cs.LG"},
    {"id": "2402.00022", "title": "Graph coloring with greedy bridges", "abstract": "Greedy bridges color large graphs. A coloring of a graph is found in linear time.", "authors": ["Cleo Marsh"], "categories": "cs.DS"},
    {"id": "2403.00033", "title": "Robot arms that learn from rivers", "abstract": "A robot arm learns to sort stones taken from a river bed.", "authors": "Dan Field", "categories": "cs.RO cs.LG"},
    {"id": "2404.00044", "title": "Measuring database caches under load", "abstract": "Database caches are measured while queries arrive. Sparse queries gain the most.", "authors": ["Eve Hill", "Flo Wood", "Gus Lake"], "categories": "cs.DB"},
    {"id": "2405.00055", "title": "Attention gates in vision models", "abstract": "Vision models with attention gates see more of an image.", "authors": ["Hal Reed"], "categories": "cs.CV"},
    {"id": "cs/9901012", "title": "An early protocol for network clocks", "abstract": "Clocks in a network drift apart. The protocol keeps them together.", "authors": ["Ivy Dune"], "categories": "cs.NI"},
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(tmp_path_factory.mktemp("local")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def papers(spark, tmp_path_factory):
    """The records as read from JSON lines, with a byte order mark and a blank line."""
    import json

    path = tmp_path_factory.mktemp("papers") / "papers.jsonl"
    path.write_text("﻿" + "\n\n".join(json.dumps(p) for p in PAPERS) + "\n", encoding="utf-8")
    from scriptorium.sources.records import read_jsonl

    return read_jsonl(spark, str(path))


@pytest.fixture(scope="session")
def store(spark, papers, tmp_path_factory):
    from scriptorium.sources.store import Store

    s = Store(spark, str(tmp_path_factory.mktemp("store") / "rows"))
    assert s.add(papers) == 6
    return s


@pytest.fixture(scope="session")
def engine(spark, store, tmp_path_factory):
    from scriptorium.plans.engine import SearchEngine

    return SearchEngine.build(spark, store.rows()).save(str(tmp_path_factory.mktemp("index")))
