"""Names of merchants: pattern cleaning, place cleaning, title case, labels of models.

The patterns are fixed values: ledgers of older tools hold names that were made by them, and
cached names match only if the same steps are taken in the same order.
"""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

# The steps of cleaning a merchant's name, in order, up to payment processors.
BEFORE_PROCESSORS = [
    (r"\bXX+\d{4}\b", ""),
    (r"(?i)^(Payment\.ACH|Payment\.|ACH\s+)", ""),
    (r"^[=\-><]\s+", ""),
    (r"(?i)^(RECUR\.?\s*PURCHASE\.?\s*|POS\s+(?:PURCHASE\s+)?AT\s+|PURCHASE\s+AT\s+)", ""),
    (r"(?i)\s+RECUR\s+PURCHASE\.?\s*", " "),
    (r"^\d{1,2}\s+", ""),
    (r"(\w)(\d{3,})(?=\s|$)", "$1"),
    (r"\s+[A-Z0-9]{1,2}$", ""),
    (r"\s*\d{3}-\d{3}-\d{4}", ""),
    (r"\s+\d{10}\b", ""),
    (r"\s+\d{3}-\d{7}", ""),
    (r"\s+[A-Z0-9]{10,}\b", ""),
    (r"\s+[a-f0-9]{8,}\b", ""),
    (r"\s+\d{8,}\b", ""),
]

# Processors whose prefix says all there is to say.
PROCESSORS = [(r"(?i)^SQSP\s*\*", "Squarespace"), (r"(?i)^CASH\s+APP\s*\*", "Cash App"), (r"(?i)^BP[#\d]", "BP")]

# The steps after payment processors; the middle ones stand around the split at "*".
AFTER_PROCESSORS = [
    (r"(?i)\s+WEB[ _](?:PMTS?|PAY)\s+\S+", ""),
    (r"\s*#\s*\d+", ""),
    (r"[-\s]+[A-Z]{5,}$", ""),
    (r"\s+\d{3}-\d{7}$", ""),
    (r"%[^%]+%", ""),
    (r"\s+\d{4,5}$", ""),
    (r"\s+[A-Z][a-z]+\s+[A-Z]{2}$", ""),
    (r"\s+[A-Z]{2}\s*\d*$", ""),
    (r"(?i)^(?:TST|SQ|PAW)\s*-\s*", ""),
    (r"\s+\d+\s+[A-Z]{2}\s+\d+$", ""),
    (r"\s+\d{3}-\d+$", ""),
    (r"(?i)\s+OIL$", ""),
    (r"^\s*([^*]*?)\s*\*\s*(.*?)\s*$", "$1 $2"),
    (r"(?i)\s+Help\.\w+\.Com", ""),
    (r"(?i)\s+Hwy\s+\d+", ""),
    (r"\s+-\s*$", ""),
    (r"^\s*-\s+", ""),
    (r"\s+[A-Z]\d+[A-Z]$", ""),
    (r"\s+[A-Z]{1,2}$", ""),
    (r"\s+", " "),
    (r"^\s+|\s+$", ""),
    (r"\s+\d+$", ""),
]

# The steps of cleaning a place, in order.
PLACE_STEPS = [
    (r"\s+\d{1,2}/\d{1,2}/\d{2,4}\b", ""),
    (r"(?i)\s+At\s*$", ""),
    (r"\s+[A-Z0-9]{8,}\s*$", ""),
    (r"(?i)\s+External\s+[A-Z]\s+", " "),
    (r"\s+[0-9A-Z]{10,}", ""),
    (r"(?i)\s+Web_Pay.*$", ""),
    (r"(?i)\s+(Online Pmt|Payments).*$", ""),
    (r"(?i)\s+WEB PMTS.*$", ""),
    (r"XXXXXX\d+", ""),
    (r"Xxxxxx\d+", ""),
    (r"(?i)^(Online-Phone Transfer To|ONLINE-PHONE TRANSFER TO)\s+", ""),
    (r"\s+", " "),
    (r"^\s+|\s+$", ""),
]

# Words that stay in capitals.
ACRONYMS = ["ATM", "POS", "ACH", "USA", "LLC", "INC", "BP", "ND", "MN"]

# What language models add to a name, and words that may end one for nothing.
MODEL_ARTIFACTS = [
    r"\(No location information.*?\)", r"\(No location.*?\)", r"No location information provided.*", r"Yes, the transaction name is:?",
    r"The transaction name is:?", r"A fun one!", r"A fun transaction!", r"the transaction details:",
]
EXTRA_WORDS = ["Purchase", "Supercenter", "Store", "Location", "Branch", "Retailer", "LLC", "Inc", "Corporation", "Company"]


def _apply(name: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, name)


def has_letter(text: Column) -> Column:
    return text.rlike(r"\pL")


def is_upper(text: Column) -> Column:
    """Some letter, and none in lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def title_words(text: Column) -> Column:
    """Each run of letters with a capital and the rest in lower case."""
    parts = F.regexp_extract_all(text, F.lit(r"(\pL+|\PL+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000)))), "")


def camel_split(name: Column) -> Column:
    return F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")


def smart_title(name: Column, original: Column | None = None) -> Column:
    """Splits camel case, keeps acronyms, and puts longer words in capitals into title case. A result
    of under three characters gives the original."""
    words = F.filter(F.split(camel_split(name), r"\s+"), lambda w: w != "")

    def one(w: Column) -> Column:
        return F.when(F.upper(w).isin(ACRONYMS), F.upper(w)).when((F.length(w) > 2) & is_upper(w), title_words(w)).otherwise(w)

    return let(F.array_join(F.transform(words, one), " "), lambda out: F.when(F.length(out) < 3, original if original is not None else name).otherwise(out))


def clean_merchant(name: Column, holders: tuple[str, ...] = ()) -> Column:
    """The readable name of a merchant from a statement's text. As these are many patterns, names are
    best cleaned once each (merchants.clean_names). holders: first names of account holders, which
    some banks print first."""
    own = [(rf"(?i)^({'|'.join(map(re.escape, holders))})\s+", "")] if holders else []

    def after(early: Column) -> Column:
        square = F.regexp_extract(early, r"(?i)SQ\s*\*\s*([A-Z][A-Z0-9&\s]+)", 1)
        stripped = (
            F.when(early.rlike(r"(?i)^SQ\s*\*"), F.when(square != "", F.trim(square)).otherwise(F.trim(F.regexp_replace(early, r"(?i)^SQ\s*\*", ""))))
            .when(early.rlike(r"(?i)^WL\s*\*"), F.trim(F.regexp_replace(early, r"(?i)^WL\s*\*\s*", "")))
            .otherwise(early)
        )

        def spaced(late: Column) -> Column:
            joined = (F.length(late) > 15) & is_upper(late) & ~F.contains(F.substring(late, 1, 10), F.lit(" "))
            return F.when(joined, F.regexp_replace(late, "([A-Z])AND([A-Z])", "$1 AND $2")).otherwise(late)

        out = F.when(early.rlike(PROCESSORS[0][0]), F.lit(PROCESSORS[0][1]))
        for pattern, full in PROCESSORS[1:]:
            out = out.when(early.rlike(pattern), F.lit(full))
        return out.otherwise(smart_title(let(_apply(stripped, AFTER_PROCESSORS), spaced), name))

    plain = F.when(F.length(name) < 3, name).when(name.rlike(r"^\$[\d,]+\.?\d*\s+AT\s+\d{1,2}:\d{2}"), F.lit("ATM Withdrawal"))
    return plain.otherwise(let(_apply(name, BEFORE_PROCESSORS[:1] + own + BEFORE_PROCESSORS[1:]), after))


def clean_place(place: Column) -> Column:
    """A place with references, masks and dates taken out, and payments put under one name."""

    def named(p: Column) -> Column:
        up = F.upper(p)
        lender = F.regexp_extract(p, r"(?i)^([\w\s]+?)\s+(AUTO|CAR)\s+(FINANCE|LOAN|FINANCING)", 1)
        loan = F.regexp_extract(p, r"(?i)^([\w\s]+?)\s+LOAN", 1)
        return (
            F.when(up.rlike("BANKCARD|BANK CARD|CARD CTR") & up.rlike("ONLINE|PMT|PAYMENT"), F.lit("Credit Card Payment"))
            .when(up.rlike("AUTO FINANCE|AUTO LOAN") & (lender != ""), F.concat(title_words(F.trim(lender)), F.lit(" Auto Loan")))
            .when(up.rlike(r"\bLOAN\s+PYMT\b|\bLOAN\s+PAYMENT\b") & (loan != ""), F.concat(title_words(F.trim(loan)), F.lit(" Loan Payment")))
            .otherwise(F.regexp_replace(p, r"(?i)\b(Financia|Financial)\b", "Financial"))
        )

    return let(_apply(place, PLACE_STEPS), named)


def normalize_label(name: Column) -> Column:
    """A model's answer as a name: without explanations, in title case, without a last filler word."""
    n = reduce(lambda c, a: F.regexp_replace(c, f"(?i){a}", ""), MODEL_ARTIFACTS, name)
    n = F.regexp_replace(F.trim(n), r"^[,\s]+|[,\s]+$", "")
    short = (F.length(n) <= 4) & n.rlike(r"^\pL+$")
    n = F.when(is_upper(n) & (F.length(n) > 3) & ~short, title_words(n)).otherwise(n)
    n = F.regexp_replace(n, "(?i)^THE ", "")
    n = F.when(~F.contains(n, F.lit(" ")), camel_split(n)).otherwise(n)
    for word in EXTRA_WORDS:
        n = F.trim(F.regexp_replace(n, rf" {word}$", ""))
    return n


def same_merchant(a: Column, b: Column) -> Column:
    """Lenient equality: one holds the other, without "the ", spaces and "&"."""

    def bare(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "the | |&", "")

    return F.contains(bare(a), bare(b)) | F.contains(bare(b), bare(a))
