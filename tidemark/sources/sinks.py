"""Writing ledgers, dictionaries and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import chronological, order_columns
from ..session import stash


def write_months(ledger: DataFrame, path: str, fmt: str = "parquet", rebuild: bool = True) -> None:
    """By month. rebuild replaces the months that the ledger has and leaves others; without it,
    months that are there already stay as they are."""
    spark = ledger.sparkSession
    if not rebuild:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            there = spark.read.format(fmt).option("header", "true").load(path).select(F.col("month").cast("string").alias("month")).distinct()
            ledger = ledger.join(there, "month", "left_anti")
    writer = ledger.write.mode("overwrite" if rebuild else "append").partitionBy("month").format(fmt)
    writer.option("partitionOverwriteMode", "dynamic").option("header", "true").save(path)


class MonthStore:
    """The versions of a month's tables below a folder.

    A version is written to a folder of its own; then an empty file is created whose name has the
    version's number and folder. That one step makes it current, so readers see all tables of the
    old version or all of the new one, and a run that fails before it changes nothing. The version
    before stays for readers that are under way; older ones, and those that were never committed,
    go with the next commit.
    """

    def __init__(self, spark: SparkSession, root: str, month: str):
        self.spark, self.folder = spark, f"{root}/{month}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, below: str) -> list[str]:
        path = self._path(f"{self.folder}/{below}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(path)) if self._files.exists(path) else []

    def current(self) -> str | None:
        """The folder of the current version, or None."""
        names = self._names("commits")
        return f"{self.folder}/versions/{names[-1].split('-', 1)[1]}" if names else None

    def read(self, table: str, schema: str) -> DataFrame:
        """A table of the current version; no rows if it has none. Columns that schema names have its types, others stay text."""
        folder, typed = self.current(), dict(c.rsplit(" ", 1) for c in schema.split(", "))
        if folder is None or not self._files.exists(self._path(f"{folder}/{table}")):
            return self.spark.createDataFrame([], schema)
        if table in STATE:
            return self.spark.read.parquet(f"{folder}/{table}")
        rows = self.spark.read.option("header", "true").option("escape", '"').csv(f"{folder}/{table}")
        return rows.select(*[F.col(c).cast(typed[c]) if c in typed else F.col(c) for c in rows.columns])

    def commit(self, tables: dict[str, DataFrame]) -> dict[str, bool]:
        """Writes the tables as the month's new version; expenses even if there are none, of the others only those with rows. Returns which were written."""
        done = self._names("commits")
        name, written = uuid.uuid4().hex, {}
        for table, rows in tables.items():
            path = f"{self.folder}/versions/{name}/{table}"
            written[table] = table == "expenses" or table in STATE or not rows.isEmpty()
            if table in STATE:
                rows.write.parquet(path)
            elif written[table]:
                ordered = chronological(order_columns(rows)) if "txn_date" in rows.columns else order_columns(rows)
                ordered.write.option("header", "true").option("escape", '"').csv(path)
        number = int(done[-1].split("-")[0]) + 1 if done else 1
        self._files.mkdirs(self._path(f"{self.folder}/commits"))
        if not self._files.createNewFile(self._path(f"{self.folder}/commits/{number:09}-{name}")):
            raise FileExistsError(f"{self.folder} has a commit {number} already")
        keep = {x.split("-", 1)[1] for x in done[-1:]} | {name}
        for old in self._names("versions"):
            if old not in keep:
                self._files.delete(self._path(f"{self.folder}/versions/{old}"), True)
        for old in done[:-1]:
            self._files.delete(self._path(f"{self.folder}/commits/{old}"), True)
        return written


STATE = ("ledger", "log")  # what a later run goes on from, in types


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_dictionary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dimension written by write_dictionary; no rows if it isn't there yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_dictionary(table: DataFrame, path: str) -> None:
    """A dimension such as the merchant cache or learned keywords, replaced as a whole."""
    table = stash(table, "dictionary")  # it may be made from what it replaces
    table.write.mode("overwrite").parquet(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document for each row, for a service to send."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
