"""From raw documents to a training order: five stages, each on what the stage before kept.

quality rules -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> mixing.
Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet
in the shared folder and reads it again for the next. All but the last return the columns of
documents; the last adds the place of each document in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from tidemark.llm.rows import row_hash
from tidemark.session import stash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learn_from_labels(docs, labels)
    return quality_rules.keep_good(docs, rules)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to earlier ones go; documents of which nothing but space is left go."""
    done = line_dedup.dedup_lines(docs)
    emptied = (F.col("line_stats.n_equal") + F.col("line_stats.n_near") > 0) & ~F.col("text").rlike(r"[^\s]")
    return done.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays.

    Rows are told apart by a hash of all their columns, as ids may be null or repeat. The row
    with the smallest id stays (by that hash if ids are equal); rows without an id come last,
    and of rows that are equal in every column there is one. A text without words is similar
    to no other, and its row stays.
    """
    key = row_hash(docs, docs.columns)
    rows = docs.select(key.alias("row_key"), F.col("doc_id").alias("id"), "text")
    found = ngram_join.similar_components(rows.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    ids = stash(rows.groupBy("row_key").agg(F.min("id").alias("id"), F.count("*").alias("n")), "row-keys")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row_key")
    first = found.join(ids, "row_key").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row_key")
    kept = docs.withColumn("row_key", key).join(first, "row_key", "left_semi")
    if not ids.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["row_key"])
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Each row is judged by its own text: ids may be null or repeat."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("row_key", row_hash(docs, docs.columns))
    leaks = decontaminate.find_contamination(keyed.select(F.col("row_key").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(leaks, "row_key", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix of sources."""
    return mixing.mix_sources(docs, mixing.WEIGHTS)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: The decision list is learned and the edit join has no feasible SQL; tests/llm holds the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
