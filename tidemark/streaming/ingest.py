"""Ledgers that grow: statements that arrive as files, and rows that arrive as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merchants import learn_names, merge_cache
from ..operators.statements import parse_statements
from ..schema import MERCHANT_CACHE
from ..sources import sinks


def stream_statements(spark: SparkSession, root: str) -> DataFrame:
    """New text statements below a folder: doc_id, path and text."""
    # The streaming text source splits files into lines, so whole files come as bytes.
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    return files.select(F.sha2("content", 256).alias("doc_id"), "path", F.decode("content", "UTF-8").alias("text"))


def ingest_new(spark: SparkSession, root: str, ledger_path: str, checkpoint: str, default_year: int) -> StreamingQuery:
    """Parses the statements that weren't there at the last call and writes their months.

    Each statement is parsed by itself, so the same rows come out as from a batch over all files.
    A batch has a folder of its own, which it writes as a whole: a batch that is tried again
    replaces what it left, so a file is taken once, whatever happens to the job.
    """

    def parse(batch: DataFrame, number: int) -> None:
        parsed = parse_statements(batch, default_year).withColumn("month", F.coalesce(F.date_format("txn_date", "yyyy-MM"), F.lit("unknown")))
        parsed.write.mode("overwrite").partitionBy("month").parquet(f"{ledger_path}/batch={number}")

    return stream_statements(spark, root).writeStream.foreachBatch(parse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_merchants(history: DataFrame, cache_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a merchant cache up to date: each batch of (place, ordinal) is merged into a new version.

    A batch that is tried again starts from the version before it, so the last two are kept."""
    spark = history.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = sinks.read_dictionary(spark, f"{cache_path}/{number - 1}", MERCHANT_CACHE)
        merge_cache(before, learn_names(batch)).write.mode("overwrite").parquet(f"{cache_path}/{number}")
        sinks.remove(spark, f"{cache_path}/{number - 2}")

    return history.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_spending(events: DataFrame, delay: str = "10 days", window: str = "30 days") -> DataFrame:
    """Running sums of (ts, statement, amount) by window; rows later than the delay are dropped with their state."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "statement").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


