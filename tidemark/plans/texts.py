"""Queries of cleaners and repairs over texts printed from whole tables, and DuckDB SQL with the same results.

Every line item prints a text out of its part's name, a number and a date of its own, in one of
several forms that its keys choose. A form is an expression that Spark and DuckDB both read;
beside it stands, for DuckDB only, what the text has to become. Each cleaner has a query over
the different texts, cleaned once each, and one over all line items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, names
from ..operators import categorize
from ..sources import providers

ITEM = [
    "l_orderkey", "l_linenumber", "l_orderkey + l_linenumber as nth", "p_name as low", "upper(p_name) as up",
    "split_part(p_name, ' ', 1) as w1", "split_part(p_name, ' ', 2) as w2",
    "upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) as c1",
    "upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) as c2",
    "cast((l_orderkey * 7 + l_partkey) % 9000 + 1000 as string) as n", "l_orderkey % 12 + 1 as m",
    "cast(l_partkey % 18 + 10 as string) as d", "cast(l_partkey % 30 + 2000 as string) as y",
]
CAP = "c1 || ' ' || c2 as cap"
DATE = "'0' || cast(m % 9 + 1 as string) || '/' || d || '/'"
#: A last word of five capitals or more is taken for a town.
WITHOUT_TOWN = "case when length(w2) >= 5 then c1 else cap end"

MERCHANTS = [
    ("up || ' #' || n || ' FARGO ND'", "cap"), ("'SQ *' || up || ' #' || n", WITHOUT_TOWN), ("'POS PURCHASE AT ' || up", WITHOUT_TOWN), ("cap || ' WEB PMTS REF' || n", "cap"),
    ("'CASH APP*' || up", "'Cash App'"), ("'BP#' || n || up", "'BP'"), ("'WL *' || cap", "cap"), ("'XX' || n || ' ' || up", WITHOUT_TOWN),
    ("'$' || n || '.00 AT 9:30'", "'ATM Withdrawal'"), ("'SQSP* INV' || n", "'Squarespace'"), ("'TST* ' || up || ' MOORHEAD MN'", "'Tst ' || cap"),
]
PLACES = [
    ("cap || ' 03/' || d || '/25'", "cap"), ("up || ' CARD CTR PAYMENT'", "'Credit Card Payment'"), ("low || ' auto loan ' || n", "cap || ' Auto Loan'"), ("up || ' LOAN PYMT'", "cap || ' Loan Payment'"),
    ("cap || ' XXXXXX' || n", "cap"), ("cap || ' External W Bank'", "cap || ' Bank'"), ("cap || ' Online Pmt ' || n", "cap"), ("'Online-Phone Transfer To ' || cap", "cap"),
    ("cap || ' Financia'", "cap || ' Financial'"), ("cap || ' At'", "cap"), ("cap || ' Web_Pay ' || n", "cap"),
]
TITLES = [
    ("up", "cap"), ("c1 || c2", "cap"), ("up || ' llc'", "cap || ' LLC'"), ("low || ' of mn'", "low || ' of MN'"), ("substr(low, 1, 2)", "substr(low, 1, 2)"), ("'ATM ' || up", "'ATM ' || cap"),
    ("'O' || chr(39) || upper(w1) || ' ' || n || '-' || upper(w2)", "'O' || chr(39) || c1 || ' ' || n || '-' || c2"),
]
LABELS = [
    ("up || ' (No location information given)'", "cap"), ("', ' || cap || ' Supercenter,'", "cap"), ("'The ' || cap || ' Store'", "cap"), ("'Yes, the transaction name is: ' || up", "cap"),
    ("c1 || c2", "cap"), ("up || ' PURCHASE'", "cap"), ("'THE ' || up", "cap"), ("upper(w1)", "case when length(w1) <= 4 then upper(w1) else c1 end"),
]
ANSWERS = [
    ("'\"' || cap || '\"'", "cap"), ("'Output: ' || cap || chr(10) || 'because'", "cap"), ("'SQ *' || cap", "cap"), ("'The merchant name is ' || cap", "null"), ("cap || ' Merchant: ' || n", "cap"),
    ("substr(low, 1, 2)", "null"), ("repeat(cap || ' ', 8)", "null"), ("n", "null"), ("cap || ' Home Depot x'", "cap || ' Home'"), ("low", "null"), ("cap", "cap"),
]
#: What an answer is about: the answer "low" is only its question again.
ORIGINAL = "case nth % 11 when 9 then up else up || ' ' || n end"
HEADS = [
    (f"'For billing cycle ending ' || {DATE} || y", "y"), (f"'Statement Closing Date ' || {DATE} || substr(y, 3, 2)", "y"), (f"'forbilling cycleending ' || {DATE} || substr(y, 3, 2)", "y"),
    (f"'Statement date: ' || {DATE} || y", "y"), (f"'Opened on ' || {DATE} || y", "'1999'"), (f"'For billing cycle ending ' || {DATE} || substr(y, 3, 2)", "y"),
]


def _month(more: int) -> tuple[str, str, str]:
    x, rest = f"(m + {more})", "'/' || d || '/2025'"
    right = f"case when {x} in (13, 14) then 11 when {x} >= 20 and {x} % 10 <= 2 then 10 + {x} % 10 else {x} end"
    tens = f"case when {x} >= 40 then {x} - 30 else {x} end"
    return f"cast({x} as string) || {rest}", f"cast({right} as string) || {rest}", f"cast({tens} as string) || {rest}"


MONTHS = [*map(_month, (0, 10, 20, 30)), ("cast(m as string) || '-' || d",) * 2 + ("cast(m as string) || '/' || d || '/2025'",)]


def _choose(forms: list[tuple], i: int) -> str:
    return f"case nth % {len(forms)} " + " ".join(f"when {n} then {f[i]}" for n, f in enumerate(forms)) + " end"


def _texts(spark: SparkSession, sf: str, forms: list[tuple], *more: str) -> DataFrame:
    items, part = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*ITEM).selectExpr("*", CAP)
    return rows.selectExpr("l_orderkey", "l_linenumber", f"{_choose(forms, 0)} as raw", *more)


def _known(forms: list[tuple], *more: str) -> str:
    results = "".join(f", {_choose(forms, i)} as result{i}" for i in range(1, len(forms[0])))
    return f"items as (select {', '.join(ITEM)}, {CAP} from lineitem join part on l_partkey = p_partkey), known as (select l_orderkey, l_linenumber, {_choose(forms, 0)} as raw{results}{''.join(', ' + x for x in more)} from items)"


def _pair(queries: dict, oracle: dict, name: str, forms: list[tuple], result: str, clean: Callable[[Column], Column]) -> None:
    def once(spark, sf):
        return _texts(spark, sf, forms).groupBy("raw").agg(F.count("*").alias("n")).select("raw", "n", clean(F.col("raw")).alias(result))

    def each(spark, sf):
        return _texts(spark, sf, forms).select("l_orderkey", "l_linenumber", clean(F.col("raw")).cast("string").alias("result"))

    queries[name], queries[f"{name}_all"] = once, each
    value = "cast(result1 as integer)" if result == "year" else "result1"
    oracle[name] = f"with {_known(forms)} select raw, count(*) as n, {value} as {result} from known group by raw, result1"
    oracle[f"{name}_all"] = f"with {_known(forms)} select l_orderkey, l_linenumber, result1 as result from known"


def month_repair(spark, sf):
    rows = _texts(spark, sf, MONTHS).select(F.col("raw").alias("date")).distinct()
    return rows.select("date", dates.repair_month(F.col("date")).alias("repaired"), dates.normalize_date(F.col("date"), 2025).alias("normalized"))


def month_repair_all(spark, sf):
    return _texts(spark, sf, MONTHS).select("l_orderkey", "l_linenumber", dates.repair_month(F.col("raw")).alias("result"))


def scrub_answers(spark, sf):
    rows = _texts(spark, sf, ANSWERS, f"{ORIGINAL} as original").select(F.col("raw").alias("answer"), "original").distinct()
    return rows.select("answer", "original", providers.scrub_answer(F.col("answer"), F.col("original")).alias("place"))


def scrub_answers_all(spark, sf):
    rows = _texts(spark, sf, ANSWERS, f"{ORIGINAL} as original")
    return rows.select("l_orderkey", "l_linenumber", providers.scrub_answer(F.col("raw"), F.col("original")).alias("result"))


# Names of categories that labels are corrected to in these queries.
CATEGORIES = [
    "Groceries", "Dining", "Transportation", "Auto Maintenance", "Utilities", "Entertainment", "Shopping", "Clothing", "Healthcare", "Insurance", "Personal Care",
    "Home Maintenance", "Rent/Mortgage", "Education", "Childcare", "Pets", "Gifts & Charity", "Subscriptions", "Travel", "Alcohol/Bar", "Banking Fees", "Investment",
]
#: A category in lower case without one of its characters, with a digit too many, between blanks; in capitals; or no category.
LABEL = """case p_partkey % 5 when 0 then ' ' || lower(substr(name, 1, cut) || substr(name, cut + 2)) || cast(p_partkey % 7 as string) when 1 then lower(substr(name, 1, cut) || substr(name, cut + 2))
  when 2 then upper(name) when 3 then 'zzz ' || cast(p_partkey as string) else ' ' end"""
CUT = "cast(floor(p_partkey / 22) as int) % length(name) as cut"
MEANT = "case p_partkey % 5 when 3 then label when 4 then 'Uncategorized' else name end as category, p_partkey % 5 <> 3 as is_valid"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("p_partkey") % len(CATEGORIES) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", name.alias("name")).selectExpr("p_partkey", "name", CUT)
    return rows.selectExpr("p_partkey", f"{LABEL} as label")


LABELS_SQL = f"""named as (select p_partkey, ([{', '.join(f"'{c}'" for c in CATEGORIES)}])[cast(p_partkey % {len(CATEGORIES)} + 1 as int)] as name from part),
  placed as (select *, {CUT} from named), labelled as (select *, {LABEL} as label from placed)"""


def category_validation_fuzzy(spark, sf):
    return categorize.correct_categories(_labels(spark, sf), CATEGORIES)


def category_validation_all(spark, sf):
    rows = _labels(spark, sf)
    return rows.join(categorize.correct_categories(rows, CATEGORIES), "label").select("p_partkey", "category", "is_valid")


def last_twelve_months(spark, sf):
    """The twelve months up to each month with an order, as a report of that month shows them."""
    anchors = spark.read.parquet(f"{sf}/orders.parquet").select(F.trunc("o_orderdate", "MM").alias("first")).distinct()
    each = anchors.select(F.date_format("first", "yyyy-MM").alias("anchor"), F.posexplode(dates.last_months(F.col("first"))).alias("at", "month"))
    return each.select("anchor", "month", (F.col("at") + 1).cast("long").alias("nth"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (last_twelve_months, month_repair, month_repair_all, scrub_answers, scrub_answers_all, category_validation_fuzzy, category_validation_all)
}
ORACLE: dict[str, str] = {
    "last_twelve_months": """select strftime(first, '%Y-%m') as anchor, strftime(first + to_months(cast(i - 11 as integer)), '%Y-%m') as month, i + 1 as nth
  from (select distinct date_trunc('month', o_orderdate) as first from orders), range(12) t(i)""",
    "month_repair": f"with {_known(MONTHS)} select distinct raw as date, result1 as repaired, result2 as normalized from known",
    "month_repair_all": f"with {_known(MONTHS)} select l_orderkey, l_linenumber, result1 as result from known",
    "scrub_answers": f"with {_known(ANSWERS, f'{ORIGINAL} as original')} select distinct raw as answer, original, result1 as place from known",
    "scrub_answers_all": f"with {_known(ANSWERS)} select l_orderkey, l_linenumber, result1 as result from known",
    "category_validation_fuzzy": f"with {LABELS_SQL} select distinct label, {MEANT} from labelled",
    "category_validation_all": f"with {LABELS_SQL} select p_partkey, {MEANT} from labelled",
}
_pair(QUERIES, ORACLE, "clean_merchant", MERCHANTS, "place", names.clean_merchant)
_pair(QUERIES, ORACLE, "clean_place", PLACES, "place", names.clean_place)
_pair(QUERIES, ORACLE, "smart_title", TITLES, "title", names.smart_title)
_pair(QUERIES, ORACLE, "normalize_names", LABELS, "label", names.normalize_label)
_pair(QUERIES, ORACLE, "statement_year", HEADS, "year", lambda text: dates.statement_year(text, 1999))
