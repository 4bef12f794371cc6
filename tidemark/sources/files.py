"""Readers of ledgers, statements and month folders."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import file_month
from ..schema import LEDGER_CSV

LEDGER_FIELDS = [c.rsplit(" ", 1)[0].strip().strip("`") for c in LEDGER_CSV.split(", ")]
LEDGER_NAMES = {c.lower() for c in LEDGER_FIELDS}
MONTH = r"/(\d{4}-\d{2})/[^/]*$"


def month_folder(path: Column) -> Column:
    """The yyyy-MM folder that a file lies in, or null."""
    return F.nullif(F.regexp_extract(path, MONTH, 1), F.lit(""))


def read_statements(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path, month, doc_id and content of statement files in month folders (or, by name, outside)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(
        "path", F.coalesce(month_folder(F.col("path")), file_month(F.col("path"))).alias("month"), F.sha2("content", 256).alias("doc_id"), "length", "content"
    )


def read_statement_texts(spark: SparkSession, root: str, extractor: str = "A") -> DataFrame:
    """Statements that are text already: doc_id, month, extractor and text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.sha2("value", 256).alias("doc_id"), F.coalesce(month_folder(path), file_month(path)).alias("month"), F.lit(extractor).alias("extractor"), F.col("value").alias("text"))


def once_each(documents: DataFrame) -> DataFrame:
    """One of each group of documents with the same content (doc_id is its hash), the first by path."""
    return documents.groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), "path").alias("d")).select("d.*")


def ledger_files(spark: SparkSession, root: str, name: str, skip_comments: bool = False) -> DataFrame:
    """path, month, header and problem of each file of a name: "empty", "no known column", or null.

    The header is the first line, or the first that is no comment and not blank; that is a read of
    each file's first block. Files of no bytes aren't there for Spark's readers, and have no row.
    """
    source = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    there = source.format("binaryFile").load(root).select("path")  # names only
    lines = source.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    first = lines.where("start = 0" if not skip_comments else r"start = 0 and not value rlike '^\\s*(#|$)'").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    header = F.rtrim(F.regexp_replace("header", "^\ufeff", ""), F.lit("\r"))
    found = there.join(first, "path", "left").select("path", month_folder(F.col("path")).alias("month"), header.alias("header"))
    names = F.transform(F.split(F.lower("header"), ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    known = F.arrays_overlap(names, F.array(*map(F.lit, sorted(LEDGER_NAMES))))
    return found.withColumn("problem", F.when(F.coalesce(F.trim("header") == "", F.lit(True)), "empty").when(~known, "no known column"))


def _places(header: str) -> dict[str, int]:
    """The column of each ledger name: the first that is spelled as asked for, else the first in another case."""
    fields = [x.strip() for x in next(csv.reader([header]))]
    lower = [x.lower() for x in fields]
    return {n: fields.index(n) if n in fields else lower.index(n.lower()) for n in LEDGER_FIELDS if n.lower() in lower}


def _raw_ledgers(spark: SparkSession, root: str, name: str, skip_comments: bool) -> DataFrame:
    """Rows of all sound files, each read by its own header, as text: the columns of a ledger, month and row (their order in a file)."""
    heads: dict[str, list[str]] = {}
    for r in ledger_files(spark, root, name, skip_comments).where("problem is null").collect():  # one for each file
        heads.setdefault(r["header"], []).append(r["path"])
    empty = spark.createDataFrame([], f"{LEDGER_CSV}, month string, row long")
    parts = [empty]
    for header, paths in sorted(heads.items()):
        places, n = _places(header), len(next(csv.reader([header])))
        schema = ", ".join(f"c{i} string" for i in range(n))
        if skip_comments:
            lines = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", r"\r?\n"), lambda x: ~x.rlike(r"^\s*(#|$)")).alias("lines"))
            rows = lines.select("path", F.posexplode("lines").alias("row", "line")).where("row > 0").select("path", F.col("row").cast("long").alias("row"), F.from_csv("line", F.lit(schema), {"mode": "PERMISSIVE"}).alias("f")).select("path", "row", "f.*")
        else:
            rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").csv(paths)
            rows = rows.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row"))
        fields = [(F.col(f"c{places[x]}") if x in places else F.lit(None).cast("string")).alias(x) for x in LEDGER_FIELDS]
        parts.append(rows.select(*fields, month_folder(F.col("path")).alias("month"), "row"))
    return reduce(DataFrame.unionByName, parts)


def read_ledgers(spark: SparkSession, root: str, name: str = "expenses.csv", skip_comments: bool = False) -> DataFrame:
    """Ledger rows of all months with typed amounts: a bad or missing amount is 0, as in the rollups.

    Each file is read by its own header: columns may come in any order, and those that it lacks are
    null. Files with the same header are one scan. Of names that differ in case only, the one
    spelled as a ledger's goes first. Files without a known column are left out; ledger_files
    reports them. skip_comments leaves out lines that start with "#", also after white space.
    """
    return typed_ledger(_raw_ledgers(spark, root, name, skip_comments).drop("row"))


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """place, ordinal and month of the expenses and income of all months, each file by its own header; ledger_files reports files that are no ledgers."""
    out = None
    for n, name in enumerate(("expenses.csv", "income.csv")):
        own = _raw_ledgers(spark, root, name, False).select(F.col("Place").alias("place"), "month", F.struct("month", F.lit(n).alias("file"), "row").alias("ordinal"))
        out = own if out is None else out.unionByName(own)
    return out.where("place is not null")


def typed_ledger(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("Transaction Date").alias("txn_date_raw"), F.try_to_date("Transaction Date", "M/d/yyyy").alias("txn_date"), F.col("Place").alias("place"),
        F.coalesce(F.col("Amount").try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)")).alias("amount"), F.col("Statement").alias("statement"),
        F.col("Classification").alias("classification"), F.col("category"), "month",
    )


def select_month(ledger: DataFrame, month: str | None = None) -> DataFrame:
    """All months, one month, or the latest one."""
    if month is None:
        return ledger
    if month == "latest":
        return ledger.join(F.broadcast(ledger.agg(F.max("month").alias("month"))), "month", "left_semi")
    return ledger.where(F.col("month") == month)
