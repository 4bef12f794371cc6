"""Amounts of money in text, as DECIMAL(12,2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
AMOUNT = r"\$?([0-9,]+\.\d{2})"


def extract_amounts(text: Column) -> Column:
    """All amounts in order; what is no number is left out."""
    found = F.regexp_extract_all(text, F.lit(AMOUNT), 1)
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast(MONEY)), lambda x: x.isNotNull())


def signed_amounts(text: Column) -> Column:
    """All amounts with their signs: a minus before, or "CR" after them, makes them negative."""
    found = F.regexp_extract_all(text, F.lit(r"(-?\s?\$?-?[0-9,]+\.\d{2}(?:\s?CR\b)?)"), 1)

    def value(x: Column) -> Column:
        size = F.regexp_replace(x, r"[^0-9.]", "").try_cast(MONEY)
        return F.when(x.rlike("-|CR"), -size).otherwise(size).cast(MONEY)

    return F.filter(F.transform(found, value), lambda x: x.isNotNull())


def strip_amounts(text: Column) -> Column:
    """A description without amounts and long reference numbers, in single spaces."""
    without = F.regexp_replace(F.regexp_replace(text, r"\$?[0-9,]+\.\d{2}", ""), r"\d{17,}", "")
    return F.trim(F.regexp_replace(without, r"\s+", " "))


def money(value: Column) -> Column:
    return F.round(value.cast("decimal(20,4)"), 2)


def percent_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100, whole)


def as_currency(value: Column) -> Column:
    """Text such as -$1,234.50."""
    text = F.format_number(F.abs(value), 2)
    return F.concat(F.when(value < 0, F.lit("-$")).otherwise(F.lit("$")), text)
