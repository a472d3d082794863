"""Gapless numbers for the rows of a table in a given order, without gathering them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bits of ``monotonically_increasing_id`` that number the rows of one partition.
_LOCAL = 33


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """The rows with a column ``name``: 0, 1, ... in the order of ``order``, which should be unique.

    The rows are range-partitioned, sorted and written once; the driver sees one count per partition.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "numbered")
    rows.orderBy(order).withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    written = spark.read.parquet(path)
    part = F.shiftright(F.col(name), _LOCAL)
    counts = sorted((r.part, r.n) for r in written.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_part long, _before long")
    placed = written.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_before") + F.col(name).bitwiseAND(F.lit((1 << _LOCAL) - 1))).select(*rows.columns, name)
