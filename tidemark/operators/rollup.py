"""Summaries of ledgers: by category, by month, by both; shares, top lists, pivots and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import percent_of
from .categorize import UNCATEGORIZED


def _category() -> Column:
    return F.coalesce("category", F.lit(UNCATEGORIZED))


def category_summary(ledger: DataFrame) -> DataFrame:
    """category, total, n and mean, largest total first."""
    out = ledger.groupBy(_category().alias("category")).agg(F.sum("amount").alias("total"), F.count("amount").alias("n"), F.round(F.avg("amount"), 2).alias("mean"))
    return out.orderBy(F.desc("total"), "category")


def by_month(ledger: DataFrame, name: str, months: list[str] | None = None) -> DataFrame:
    rows = ledger if months is None else ledger.where(F.col("month").isin(months))
    return rows.groupBy("month").agg(F.sum("amount").alias(name))


def recent_months(ledger: DataFrame, anchor: str, n: int = 12) -> DataFrame:
    """Rows of the n months up to the anchor date's own."""
    low = F.date_format(F.add_months(F.trunc(F.lit(anchor).cast("date"), "MM"), 1 - n), "yyyy-MM")
    return ledger.where(F.col("month").between(low, F.date_format(F.lit(anchor).cast("date"), "yyyy-MM")))


def by_category(ledger: DataFrame, month: str) -> DataFrame:
    return ledger.where(F.col("month") == month).groupBy(_category().alias("category")).agg(F.sum("amount").alias("amount"))


def by_month_and_category(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("month", _category().alias("category")).agg(F.sum("amount").alias("amount"))


def month_category_pivot(ledger: DataFrame, categories: list[str]) -> DataFrame:
    """month, one column for each category (0 where there is nothing) and total, of all categories."""
    wide = ledger.groupBy("month").agg(*[F.coalesce(F.sum(F.when(_category() == c, F.col("amount"))), F.lit(0)).alias(c) for c in categories], F.sum("amount").alias("total"))
    return wide


def savings(expenses: DataFrame, income: DataFrame, full: bool = False) -> DataFrame:
    """month, expense, income and savings, by the months that have expenses; full also has others."""
    out = by_month(expenses, "expense").join(by_month(income, "income"), "month", "full_outer" if full else "left")
    zero = F.lit(0).cast("decimal(12,2)")
    return out.select("month", F.coalesce("expense", zero).alias("expense"), F.coalesce("income", zero).alias("income"), (F.coalesce("income", zero) - F.coalesce("expense", zero)).alias("savings"))


def totals(expenses: DataFrame, income: DataFrame, month: str) -> DataFrame:
    """One row: all expenses, all income, the mean monthly income, what is left of it after a month, and the number of categories."""
    e = expenses.agg(
        F.sum("amount").alias("total_expenses"), F.count_distinct(_category()).alias("n_categories"), F.coalesce(F.sum(F.when(F.col("month") == month, F.col("amount"))), F.lit(0)).alias("month_expenses")
    )
    i = income.agg(F.sum("amount").alias("total_income"), F.count_distinct("month").alias("n_months"))
    both = e.join(F.broadcast(i), F.lit(True))  # one row each
    mean = F.try_divide(F.col("total_income").cast("double"), F.col("n_months"))
    return both.select("total_expenses", "total_income", "n_months", "n_categories", F.round(mean, 2).alias("avg_income"), F.round(mean - F.col("month_expenses").cast("double"), 2).alias("avg_savings"))


def with_share(rows: DataFrame, amount: str = "amount") -> DataFrame:
    """rows with percent: each amount's part of all. The sum is one row, joined back."""
    whole = rows.agg(F.sum(amount).alias("whole"))
    return rows.join(F.broadcast(whole), F.lit(True)).withColumn("percent", F.round(percent_of(F.col(amount).cast("double"), F.col("whole").cast("double")), 4)).drop("whole")


def top_k(rows: DataFrame, k: int, amount: str = "amount", tie: str = "category") -> DataFrame:
    return rows.orderBy(F.desc(amount), tie).limit(k)


def report(ledger: DataFrame) -> DataFrame:
    """One row: rows in all, with and without a category, and percentages (null for no rows)."""
    with_category = F.count_if(F.coalesce(F.col("category"), F.lit(UNCATEGORIZED)) != UNCATEGORIZED)
    out = ledger.agg(F.count("*").alias("total"), with_category.alias("categorized"))
    rest = F.col("total") - F.col("categorized")
    return out.select("total", "categorized", rest.alias("uncategorized"), F.round(percent_of(F.col("categorized"), F.col("total")), 2).alias("categorized_pct"), F.round(percent_of(rest, F.col("total")), 2).alias("uncategorized_pct"))


def uncategorized_merchants(ledger: DataFrame) -> DataFrame:
    return ledger.where(_category() == UNCATEGORIZED).groupBy("place").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def statement_counts(rows: DataFrame) -> DataFrame:
    """Rows by statement and type."""
    return rows.groupBy("statement", "type").agg(F.count("*").alias("n"))


def leaderboard(results: DataFrame) -> DataFrame:
    """model, accuracy and mean seconds, from model, correct (0 or 1) and seconds; best and fastest are marked."""
    each = results.groupBy("model").agg(F.count("*").alias("total"), F.round(percent_of(F.sum("correct"), F.count("*")), 2).alias("accuracy"), F.round(F.avg("seconds"), 4).alias("mean_seconds"))
    best = each.agg(F.max_by("model", F.struct("accuracy", F.negative("mean_seconds"), "model")).alias("b"), F.min_by("model", F.struct("mean_seconds", "model")).alias("f"))
    return each.join(F.broadcast(best), F.lit(True)).select("model", "total", "accuracy", "mean_seconds", (F.col("model") == F.col("b")).alias("is_best"), (F.col("model") == F.col("f")).alias("is_fastest"))


def order_columns(ledger: DataFrame, first: tuple[str, ...] = ("txn_date", "place", "amount", "statement")) -> DataFrame:
    return ledger.select(*[c for c in first if c in ledger.columns], *[c for c in ledger.columns if c not in first])


def chronological(ledger: DataFrame, *more: str, strict: bool = False) -> DataFrame:
    """By date, unreadable ones last; strict sorts the dates as they are printed, as older ledgers did."""
    return ledger.orderBy(F.asc_nulls_first("txn_date_raw") if strict else F.asc_nulls_last("txn_date"), *more)
