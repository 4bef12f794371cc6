"""The test tables as ledgers: orders, line items and events seen as transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import MONEY


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_orderdate").cast("date").alias("txn_date"), F.col("o_orderpriority").alias("place"),
        F.col("o_totalprice").cast(MONEY).alias("amount"), F.col("o_orderstatus").alias("statement"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
    )


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, part = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    return t.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").cast("date").alias("txn_date"), F.col("p_name").alias("place"), F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.col("l_returnflag").alias("statement"), F.date_format("l_shipdate", "yyyy-MM").alias("month"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(
        F.col("event_id").alias("txn_id"), F.col("ts").cast("date").alias("txn_date"), F.col("value").cast(MONEY).alias("amount"),
        F.col("event_type").alias("statement"), F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("place"),
    )


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed as statements, one for each customer: doc_id and text."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    amount = F.format_string("%.2f", F.col("o_totalprice").cast(MONEY).cast("double"))
    line = F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" ORDER "), F.regexp_replace("o_orderpriority", "[^A-Z]", ""), F.lit(" SHOP $"), amount)
    each = t.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    return each.select("doc_id", F.concat(F.lit("ACCOUNT ACTIVITY\n"), body, F.lit("\nTOTAL DEBITS $0.00\nnothing more")).alias("text"))
