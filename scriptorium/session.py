"""A Spark session for the command line, and what jobs need of any session: scratch space, inputs over all cores."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "scriptorium") -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if not os.environ.get("SPARK_REMOTE") and not os.environ.get("MASTER"):
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session (as in tests) gets a folder of its own when it is unset.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Stored bytes that one partition of a dealt scan should hold: what a task keeps of them grows with these, not with the table.
PART_BYTES = 8 << 20


def stored_bytes(rows: DataFrame) -> int:
    """The bytes of the files that a plan reads, 0 where they are not known (a database)."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def spread(rows: DataFrame, key: str, bounded: bool = True) -> DataFrame:
    """A scan dealt over the cores by key, in parts of bounded size; one of enough and small splits stays as it is.

    bounded: small splits are needed, since their rows are aggregated; else enough splits are enough.

    Rows of one key stand in one partition afterwards, so that aggregates by the key and more need no other shuffle. Such an
    aggregate keeps all groups of a partition, so the number of partitions grows with the table.
    """
    cores, splits = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    parts = max(cores, -(-stored_bytes(rows) // PART_BYTES))
    return rows.repartition(parts, key) if splits < (max(2 * cores, parts) if bounded else 2 * cores) else rows
