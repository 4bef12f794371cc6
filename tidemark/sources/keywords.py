"""Keyword lists and category dictionaries: built-in values, and readers of JSON files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORY_KEYWORDS, KEYWORDS

# Text that marks a credit in a bank account.
INCOME = [
    "DEPOSIT", "MOBILE DEPOSIT", "DIRECT DEPOSIT", "DD ", "INTEREST", "INTEREST EARNED", "TRANSFER FROM", "PAYMENT RECEIVED", "PAYROLL", "SALARY", "WAGE",
    "WAGES", "INCOME", "REFUND", "TAX REFUND", "DIVIDEND", "CREDIT ADJUSTMENT", "REIMBURSEMENT", "CASHBACK", "CASH BACK", "BONUS",
]

# Text that marks a move between accounts.
TRANSFERS = [
    "ONLINE PHONE", "ONLINE-PHONE", "PHONE TRANSFER", "ONLINE TRANSFER", "TRANSFER FROM", "TRANSFER TO", "DDA XFER", "SAV XFER", "XFER FROM", "XFER TO",
    "MOBILE TRANSFER", "ONLINE PAYMENT", "ONLINEPAYMENT", "ONLINE PMT", "EXTERNAL TRANSFER", "EXTERNAL", "PAYMENT ACH", "ACH PAYMENT", "INTERNAL TRANSFER",
    "ACCOUNT TRANSFER", "BANK TRANSFER", "ONLINE BANKING", "MOBILE BANKING", "WIRE TRANSFER", "AUTOMATIC TRANSFER", "AUTO TRANSFER", "RECURRING TRANSFER",
    "TRANSFER OUT", "TRANSFER IN", "FUNDS TRANSFER", "BALANCE TRANSFER", "ACCOUNT-TO-ACCOUNT", "A2A TRANSFER", "SAVINGS TRANSFER", "CHECKING TRANSFER",
    "CREDIT CARD PAYMENT FROM", "PMT FROM CHECKING", "PMT FROM SAVINGS",
]

# Payment apps; strict ledgers know all but "APPLE CASH".
PAYMENT_APPS = ["VENMO", "ZELLE", "CASH APP", "CASHAPP", "APPLE PAY", "APPLE CASH", "PAYPAL"]

# Categories where no dictionary is given, in order: the first that fits counts.
CATEGORIES = {
    "Groceries": ["walmart", "target", "kroger", "grocery", "supermarket"],
    "Dining": ["restaurant", "cafe", "coffee", "pizza", "food"],
    "Transportation": ["gas", "fuel", "uber", "lyft", "parking"],
    "Utilities": ["electric", "power", "water", "internet", "phone"],
    "Shopping": ["amazon", "ebay", "store", "shop"],
    "Healthcare": ["pharmacy", "cvs", "walgreens", "medical", "doctor"],
}


def payment_apps(strict: bool = False) -> list[str]:
    return [k for k in PAYMENT_APPS if not (strict and k == "APPLE CASH")]


def _json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file as a dictionary, read by Spark, so from any store; None if it isn't there."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def keyword_table(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(words)), KEYWORDS)


def read_keywords(spark: SparkSession, path: str, key: str, default: list[str] = ()) -> list[str]:
    """A list of keywords under a key of a JSON file; a missing file or key gives the default."""
    return list((_json(spark, path) or {}).get(key, default))


def read_categories(spark: SparkSession, path: str | None = None) -> dict[str, list[str]]:
    """An ordered dictionary of categories from a JSON file's "categories"; built-in ones without a file."""
    found = _json(spark, path) if path else None
    return CATEGORIES if found is None else found.get("categories", {})


def category_table(spark: SparkSession, categories: dict[str, list[str]]) -> DataFrame:
    """The dictionary as rows with explicit order."""
    rows = [(i, c, j, k) for i, (c, ks) in enumerate(categories.items()) for j, k in enumerate(ks)]
    return spark.createDataFrame(rows, CATEGORY_KEYWORDS)


def add_category(categories: dict[str, list[str]], name: str, keywords: list[str]) -> dict[str, list[str]]:
    """The dictionary with one category's keywords set; a new category comes last."""
    return {**categories, name: list(keywords)}


def learn_keywords(known: DataFrame, learned: DataFrame) -> DataFrame:
    """known (category, keyword) and those of learned (category, keyword) that known lacks in any case."""
    have = known.select("category", F.lower("keyword").alias("key")).distinct()
    new = learned.where("trim(keyword) <> ''").groupBy("category", F.lower("keyword").alias("key")).agg(F.min("keyword").alias("keyword"))
    return known.select("category", "keyword").unionByName(new.join(have, ["category", "key"], "left_anti").select("category", "keyword"))
