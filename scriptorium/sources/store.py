"""The document store: a Parquet table with batched, de-duplicated appends and ordered scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .records import normalise

SCHEMA = "id long, arxiv_id string, title string, abstract string, authors string, categories string, primary_category string, published string"


def new_records(records: DataFrame, stored: DataFrame, order: Column) -> DataFrame:
    """Records with a title and an abstract, the first of each id by ``order``, whose id is not stored."""
    full = records.where("coalesce(title, '') <> '' and coalesce(abstract, '') <> ''")
    first = Window.partitionBy("id").orderBy(order)
    return full.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(stored.select(F.col("arxiv_id").alias("id")), "id", "left_anti")


def page(store: DataFrame, after: int, size: int) -> DataFrame:
    """The next rows in the order of id."""
    return store.where(F.col("id") > after).orderBy("id").limit(size)


def by_ids(store: DataFrame, ids: list[int]) -> DataFrame:
    return store.where(F.col("id").isin(*ids)) if ids else store.limit(0)


def naive_search(store: DataFrame, words: list[str], limit: int = 10) -> DataFrame:
    """Ids of documents that hold every word as a substring of title or abstract, whatever the case, in the order of id."""
    if not words:
        return store.select("id").limit(0)
    holds = lambda w: F.contains(F.lower("title"), F.lit(w.lower())) | F.contains(F.lower("abstract"), F.lit(w.lower()))
    return store.where(reduce(lambda a, b: a & b, map(holds, words))).select("id").orderBy("id").limit(limit)


#: The table of a store in a database.
TABLE = "documents"
#: Small row groups, sorted by id: a lookup by ids reads few of them.
ROW_GROUP = 1 << 20


def write_sorted(rows: DataFrame, path: str) -> None:
    """Append rows to a store's folder in the order of id."""
    rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)


class Store:
    """A folder of Parquet files with the columns of SCHEMA, or a table ``documents`` of the database that a ``jdbc:`` URL names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.in_database = spark, path, path.startswith("jdbc:")
        if not self._exists():
            self._append(spark.createDataFrame([], SCHEMA))

    def _exists(self) -> bool:
        if self.in_database:
            try:
                self.spark.read.jdbc(self.path, TABLE)
            except Exception as e:
                # a missing table; a database that cannot be reached fails again when the table is made
                if "does not exist" not in str(e).lower() and "doesn't exist" not in str(e).lower() and "no such table" not in str(e).lower():
                    raise
                return False
            return True
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _append(self, rows: DataFrame) -> None:
        if self.in_database:
            # one transaction per task
            rows.write.jdbc(self.path, TABLE, mode="append")
        elif rows.isEmpty():
            rows.write.parquet(self.path)
        else:
            write_sorted(rows, self.path)

    @property
    def kind(self) -> str:
        return self.path.split(":")[1] if self.in_database else "parquet"

    def rows(self) -> DataFrame:
        if self.in_database:
            found = self.spark.read.jdbc(self.path, TABLE)
            names = {c.lower(): c for c in found.columns}
            return found.select(*(F.col(names[c]).cast(t).alias(c) for c, t in (f.split() for f in SCHEMA.split(", "))))
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def count(self) -> int:
        return self.rows().count()

    def add(self, records: DataFrame) -> int:
        """Append what is new, with ids that go on from the largest; returns how many rows were added."""
        before = self.rows()
        last = before.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        kept = numbered(new_records(records.withColumn("_at", F.monotonically_increasing_id()), before, F.col("_at")), F.col("_at"), "_n")
        n = kept.count()
        if n:
            rows = normalise(kept, "_n").withColumn("id", F.col("_n") + last + 1).select(*(f.name for f in before.schema))
            self._append(rows)
        return n

    def page(self, after: int, size: int) -> DataFrame:
        return page(self.rows(), after, size)

    def documents(self, size: int = 5000):
        """All rows in the order of id, without holding more than a partition on the driver."""
        return self.rows().orderBy("id").toLocalIterator()

    def get(self, ids: list[int]) -> DataFrame:
        return by_ids(self.rows(), ids)

    def naive_search(self, words: list[str], limit: int = 10) -> DataFrame:
        return naive_search(self.rows(), words, limit)
