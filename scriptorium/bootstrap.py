"""Bring up an engine: fill an empty store from the sample, load the index or build it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from .config import Settings
from .plans.engine import SearchEngine
from .sources.records import read_jsonl
from .sources.store import Store


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def prepare(spark: SparkSession, settings: Settings, log: Callable[[str], None] = lambda _: None) -> SearchEngine:
    store = Store(spark, settings.store_path)
    if store.count() == 0 and exists(spark, settings.sample_path):
        log(f"added {store.add(read_jsonl(spark, settings.sample_path))} sample papers")
    engine = SearchEngine.prepare(spark, settings.index_path, store.rows())
    log(f"{store.count()} papers indexed")
    return engine
