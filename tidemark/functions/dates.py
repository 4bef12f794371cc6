"""Dates of statements: leading dates, misread months, manual entries, month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

LONG, SHORT, DASH = r"^(\d{1,2}/\d{1,2}/\d{4})", r"^(\d{1,2}/\d{1,2}/\d{2})", r"^(\d{1,2}-\d{1,2})\s"
ANY_DATE = r"^(\d{1,2}/\d{1,2}/\d{2}|\d{1,2}-\d{1,2}\s)"

# Months as text recognition misreads them, and what they stand for.
MISREAD_MONTHS = {42: 12, 41: 11, 40: 10, 14: 11, 13: 11}

# Where a statement's year stands in its lower-cased text, in order of trust.
YEAR_PATTERNS = [
    r"(?:billing cycle|statement).*?ending.*?\d{1,2}/\d{1,2}/(\d{4})",
    r"statement closing date.*?\d{1,2}/\d{1,2}/(\d{2,4})",
    r"statement date.*?\d{1,2}/\d{1,2}/(\d{4})",
    r"forbilling cycleending \d{1,2}/\d{1,2}/(\d{2})",
    r"for billing cycle ending \d{1,2}/\d{1,2}/(\d{2})",
]


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def leading_date(line: Column, year: Column) -> Column:
    """The date that a line starts with, as month/day/year text, or null. Years of two digits are
    in this century; dates without a year get the statement's."""
    short, dash = _found(line, SHORT), _found(line, DASH)
    return F.coalesce(
        _found(line, LONG),
        F.concat(F.regexp_extract(short, r"^(\d+/\d+/)", 1), F.lit("20"), F.regexp_extract(short, r"(\d\d)$", 1)),
        F.concat(F.replace(dash, F.lit("-"), F.lit("/")), F.lit("/"), year.cast("string")),
    )


def skip_date(line: Column) -> Column:
    """A line without the date that it starts with."""
    without = F.regexp_replace(line, r"^(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}/\d{1,2}/\d{2}|\d{1,2}-\d{1,2}\s)", "")
    return F.trim(without)


def repair_month(date: Column) -> Column:
    """Puts right months over 12 that text recognition is known to make out of others."""

    def meant(month: Column) -> Column:
        known = F.lit(None).cast("int")
        for wrong, right in MISREAD_MONTHS.items():
            known = F.when(month == wrong, right).otherwise(known)
        tens = F.when((F.floor(month / 10) > 1) & (month % 10 <= 2), month % 10 + 10)
        return F.when(month > 12, F.coalesce(known, tens))

    right = let(F.regexp_extract(date, r"^\s*(\d+)\s*/", 1).try_cast("int"), meant)
    return F.when(right.isNull(), date).otherwise(F.regexp_replace(date, r"^[^/]*", right.cast("string")))


def normalize_date(date: Column, year: int | Column, strict: bool = False) -> Column:
    """month/day/year text from dates with a misread tens digit or without a year.

    strict also takes the 4 of April for a misread 1, as a known fault of older ledgers.
    """
    year = F.lit(year).cast("string") if isinstance(year, int) else year.cast("string")
    month = F.regexp_extract(date, r"^(\d+)", 1).try_cast("int")
    misread = date.startswith("4") if strict else (date.startswith("4") & (month > 12))
    fixed = F.when(misread, F.concat(F.lit("1"), F.substring(date, 2, 100))).otherwise(date)
    dashed = F.replace(fixed, F.lit("-"), F.lit("/"))
    return F.when(fixed.rlike(r"^\d{1,2}[-/]\d{1,2}$"), F.concat(dashed, F.lit("/"), year)).otherwise(fixed)


def to_date(text: Column) -> Column:
    """A date from month/day/year text, null if it isn't one."""
    return F.try_to_date(text, "M/d/yyyy")


def parse_manual_date(text: Column, year: int | Column) -> Column:
    """A typed date from what people enter: seven forms, tried in order; without a year, `year`'s."""
    year = F.lit(year) if isinstance(year, int) else year
    t = F.trim(text)
    full = [F.try_to_date(t, f) for f in ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "M/d/yy", "M-d-yy")]
    # Without a year the day has to exist in a common year, so the 29th of February doesn't.
    part = F.coalesce(*[F.when(t.rlike(p), F.try_to_date(F.concat(t, F.lit(s)), f)) for p, s, f in ((r"^\d{1,2}/\d{1,2}$", "/1970", "M/d/yyyy"), (r"^\d{1,2}-\d{1,2}$", "-1970", "M-d-yyyy"))])
    return F.coalesce(*full, F.make_date(year.cast("int"), F.month(part), F.day(part)))


def statement_year(text: Column, default: int | Column) -> Column:
    """The year that a statement names for its end, or the default."""
    default = F.lit(default) if isinstance(default, int) else default

    def named(low: Column) -> Column:
        found = F.coalesce(*[_found(low, p) for p in YEAR_PATTERNS])
        return F.when(F.contains(low, F.lit("statement")) | F.contains(low, F.lit("billing cycle")), found)  # one of them is in each pattern

    def year(found: Column) -> Column:
        return F.when(F.length(found) == 2, found.try_cast("int") + 2000).otherwise(found.try_cast("int"))

    return F.coalesce(let(let(F.lower(text), named), year), default.cast("int"))


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def last_months(anchor: Column, n: int = 12) -> Column:
    """The n months up to the anchor's own, as yyyy-MM, in order."""
    first = F.trunc(anchor, "MM")
    return F.transform(F.sequence(F.lit(1 - n), F.lit(0)), lambda i: F.date_format(F.add_months(first, i), "yyyy-MM"))


def previous_month(anchor: Column) -> Column:
    return F.date_format(F.add_months(F.trunc(anchor, "MM"), -1), "yyyy-MM")


def file_month(path: Column) -> Column:
    """yyyy-MM from a date in a file's name, or null."""
    return _found(path, r"(\d{4}-\d{2})-\d{2}")
