"""The review loop: rows that people decide on, entries that they add, and what is learned from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_manual_date
from ..sources.providers import TextProvider
from .categorize import UNCATEGORIZED, correct_categories
from .classify import in_month, is_payment_app, review_state, split


def route(ledger: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """expenses, income, and review (expenses by payment apps, and uncategorized ones)."""
    expenses, income = split(ledger, F.col("type") == "Expense")
    income = income.where("type = 'Income'")
    by_app, expenses = split(expenses, is_payment_app(F.col("place"), strict))
    unknown, expenses = split(expenses, F.coalesce("category", F.lit(UNCATEGORIZED)) == UNCATEGORIZED)
    review = by_app.withColumn("uncategorized", F.lit(False)).unionByName(unknown.withColumn("uncategorized", F.lit(True)))
    return {"expenses": expenses, "income": income, "review": review.withColumn("classification", F.lit(""))}


def manual_entries(entries: DataFrame, month: str, valid: list[str]) -> DataFrame:
    """Hand-written rows (date, place, amount, category as text) with types, and status: "ok",
    "bad date", "other month" or "bad amount"."""
    date = parse_manual_date(F.col("date"), int(month[:4]))
    rows = entries.withColumns({"txn_date": date, "value": F.col("amount").try_cast("decimal(12,2)")})
    labels = correct_categories(rows.select(F.col("category").alias("label")), valid)
    rows = rows.withColumn("label", F.coalesce("category", F.lit(""))).drop("category").join(labels.withColumn("label", F.coalesce("label", F.lit(""))).dropDuplicates(["label"]), "label", "left")
    status = (
        F.when(F.col("txn_date").isNull(), "bad date").when(~in_month(F.col("txn_date"), F.lit(month)), "other month").when(F.col("value").isNull(), "bad amount").otherwise("ok")
    )
    return rows.select("txn_date", "place", F.col("value").alias("amount"), "category", "is_valid", status.alias("status"))


def apply_review(expenses: DataFrame, income: DataFrame, review: DataFrame) -> dict[str, DataFrame]:
    """Decided rows move to their ledgers, keeping the categories that people gave; open ones stay.

    A row of another word stays open too. The result comes from its inputs alone, so running it
    again on the same inputs changes nothing.
    """
    state = review_state(F.col("classification"))
    spent = review.where(state == "expense").drop("classification", "uncategorized")
    earned = review.where(state == "income").drop("classification", "uncategorized")
    return {
        "expenses": expenses.unionByName(spent, allowMissingColumns=True), "income": income.unionByName(earned, allowMissingColumns=True),
        "review": review.where(state.isin("open", "other")),
    }


def with_valid_categories(reviewed: DataFrame, valid: list[str], provider: TextProvider | None = None) -> DataFrame:
    """reviewed with corrected categories, and is_valid."""
    labels = correct_categories(reviewed.select(F.col("category").alias("label")), valid, provider=provider).withColumnRenamed("category", "corrected")
    return reviewed.join(labels, reviewed["category"].eqNullSafe(labels["label"]), "left").withColumn("category", F.col("corrected")).drop("label", "corrected")


def learned_keywords(reviewed: DataFrame, valid: list[str]) -> DataFrame:
    """category and keyword from decided rows with a valid category."""
    labels = correct_categories(reviewed.select(F.col("category").alias("label")), valid).where("is_valid")
    rows = reviewed.where(review_state(F.col("classification")) == "expense").join(labels.withColumnRenamed("category", "right_category"), reviewed["category"] == labels["label"])
    return rows.where(F.col("right_category") != UNCATEGORIZED).select(F.col("right_category").alias("category"), F.lower(F.trim("place")).alias("keyword")).distinct()


def not_blank(column: Column) -> Column:
    return F.coalesce(F.trim(column) != "", F.lit(False))


def _key(*columns: str) -> Column:
    """Tells equal hand-written rows apart by their number among themselves."""
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0)))
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns], nth.cast("string")), 256)


def log_entries(entries: DataFrame, at: int) -> DataFrame:
    """manual_entries() as records of a log. An entry is known by its date, place and amount, so that a new category replaces the old one."""
    rows = entries.where("status = 'ok'").withColumn("txn_id", F.concat(F.lit("hand/"), _key("txn_date", "place", "amount")))
    return rows.select(F.lit("entry").alias("kind"), F.lit(at).cast("long").alias("at"), "txn_id", "txn_date", "place", "amount", "category", "is_valid", F.lit("Expense").alias("type"))


def log_decisions(reviewed: DataFrame, at: int) -> DataFrame:
    """Rows of a review, as people left it, as records of a log. Rows that people added, without an id, are known by their date, place and amount."""
    own = F.concat(F.lit("added/"), _key("txn_date", "place", "amount"))
    rows = reviewed.withColumn("txn_id", F.coalesce(F.nullif(F.col("txn_id"), F.lit("")), own)) if "txn_id" in reviewed.columns else reviewed.withColumn("txn_id", own)
    return rows.select(F.lit("decision").alias("kind"), F.lit(at).cast("long").alias("at"), *rows.columns)


def fold(log: DataFrame) -> DataFrame:
    """The record that counts for each id: the latest; one that is still open doesn't undo an earlier decision."""
    decided = review_state(F.col("classification")).isin("income", "expense")
    order = F.struct((F.col("kind") == "decision") & decided, "at")
    return log.groupBy("kind", "txn_id").agg(F.max_by(F.struct(*[c for c in log.columns if c not in ("kind", "txn_id")]), order).alias("r")).select("kind", "txn_id", "r.*")
