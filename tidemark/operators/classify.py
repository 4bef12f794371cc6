"""Income or expense, and the routing of rows that people have to decide on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import any_of
from ..sources.keywords import INCOME, payment_apps
from ..sources.providers import TextProvider, ask_each, income_or_expense

# Rows that are balances, interest or card payments, not spending.
NOISE = ["Beginning Balance", "Ending Balance", "Interest", "ONE TRANSFER FROM", "TRANSFER FROM", "Payment Thank", "Online Payment"]
NOT_INCOME_NOISE = ["Interest"]


def is_noise(place: Column, kind: Column | None = None, strict: bool = True) -> Column:
    """Rows to leave out; unless strict, interest that is income stays."""
    hit = F.coalesce(any_of(F.lower(place), [w.lower() for w in NOISE]), F.lit(False))
    if strict or kind is None:
        return hit
    others = F.coalesce(any_of(F.lower(place), [w.lower() for w in NOISE if w not in NOT_INCOME_NOISE]), F.lit(False))
    return F.when(kind == "Income", others).otherwise(hit)


def is_payment_app(place: Column, strict: bool = False) -> Column:
    return F.coalesce(any_of(F.upper(place), payment_apps(strict)), F.lit(False))


def transaction_type(is_bank: Column, amount: Column, debits: Column, credits: Column, original: Column, keywords: list[str] = INCOME, strict: bool = False, advice: Column | None = None) -> Column:
    """"Income", "Expense", or null for rows that say neither.

    A card's rows are expenses. In a bank account credits are income and debits expenses; a lone
    amount is income if the text says so, or the advice ("income") that was sought. Unless strict, a negative lone amount is money that
    comes back, and an amount of zero stays, as an expense.
    """
    says = F.coalesce(any_of(F.upper(original), keywords), F.lit(False))
    if advice is not None:
        says |= F.coalesce(advice == "income", F.lit(False))
    out = F.when(~is_bank, F.lit("Expense")).when(credits > 0, F.lit("Income")).when(debits > 0, F.lit("Expense")).when((amount > 0) & says, F.lit("Income")).when(amount > 0, F.lit("Expense"))
    return out if strict else out.when(amount < 0, F.lit("Income")).when(amount == 0, F.lit("Expense"))


def ask_kinds(rows: DataFrame, provider: TextProvider | None, keywords: list[str] = INCOME, strict: bool = False) -> DataFrame:
    """rows with advice, a provider's "income" or "expense" on what payment apps moved in a bank account where only a lone
    amount is known and no keyword tells; null for others. An answer of other words, or none, is "expense"."""
    app = is_payment_app(F.col("place"), strict) | is_payment_app(F.col("place_original"), strict)
    told = F.coalesce(any_of(F.upper("place_original"), keywords), F.lit(False))
    unknown = F.col("is_bank_account") & ~F.coalesce(F.col("credits") > 0, F.lit(False)) & ~F.coalesce(F.col("debits") > 0, F.lit(False)) & (F.col("amount") > 0) & ~told & app
    value = F.col("amount").cast("decimal(12,2)").cast("string")
    prompt = F.concat(F.lit("Is this bank transaction income or an expense? Answer with one word.\nName: "), F.upper("place"), F.lit("\nAmount: $"), value)
    asked = ask_each(rows, F.when(unknown, prompt), provider, "_answer")
    kind = F.coalesce(income_or_expense(F.col("_answer")), F.lit("expense"))
    return asked.withColumn("advice", F.when(unknown, kind) if provider is not None else F.lit(None).cast("string")).drop("_answer")


def split(ledger: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that pass and the others; a null test counts as not passed."""
    known = F.coalesce(test, F.lit(False))
    return ledger.where(known), ledger.where(~known)


def review_state(classification: Column) -> Column:
    """"income", "expense", "open" for blank, or "other"."""
    word = F.upper(F.trim(F.coalesce(classification, F.lit(""))))
    return F.when(word == "", "open").when(word == "INCOME", "income").when(word == "EXPENSE", "expense").otherwise("other")


def in_month(date: Column, month: Column) -> Column:
    """Whether a date exists and lies in a yyyy-MM month."""
    return F.coalesce(F.date_format(date, "yyyy-MM") == month, F.lit(False))
