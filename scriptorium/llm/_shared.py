"""Helpers that the operators share: reliable intermediate tables and text primitives."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes 0x41-0x5A to lower case, all others as they are.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def quoted(name: str) -> str:
    """A column's name as Spark parses it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it none of the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows that a worker takes at a time where it makes much of each.
SLICE = 1024


class Scratch:
    """Intermediate Parquet tables of one operator call, written below the shared folder.

    A written table cuts the lineage and survives the loss of an executor.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for df in tables:
            remove(self.spark, df._scratch_path)


def map_whole_rows(docs: DataFrame, text_col: str, run) -> DataFrame:
    """``run`` (batches, place of the text) over whole rows, all columns passing by place, whatever their names."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    k = docs.columns.index(text_col)
    return plain.mapInArrow(lambda batches: run(batches, k), plain.schema).toDF(*docs.columns)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, so that other columns never clash with those an operator adds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts(batch: pa.RecordBatch, name: str | int = "text"):
    """The texts of a batch one by one, null as None; only one is held as a Python string at a time."""
    return (x.as_py() for x in batch.column(name if isinstance(name, int) else batch.schema.get_field_index(name)))


def slices(batches):
    """The batches in parts of at most ``SLICE`` rows, so that what is made of them, here and in the JVM, is as small.

    At the end the allocator gives back what it holds unused: workers live on for other tasks.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)
    pa.default_memory_pool().release_unused()
