"""Dates, amounts, names and labels by cases with known results."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import amounts, dates, names
from tidemark.operators import categorize
from tidemark.plans import texts
from tidemark.sources import keywords, providers


def each(spark, cases, column):
    """What the column makes of each case's input."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_month_repair(spark):
    cases = {"42/29/2025": "12/29/2025", "41/03/2025": "11/03/2025", "40/01/2025": "10/01/2025", "14/05/2025": "11/05/2025", "13/05/2025": "11/05/2025", "22/05/2025": "12/05/2025", "30/05/2025": "10/05/2025", "15/05/2025": "15/05/2025", "23/05/2025": "23/05/2025", "09/05/2025": "09/05/2025"}
    assert each(spark, cases, dates.repair_month) == list(cases.values())


def test_normalize_date(spark):
    cases = {"41/03/2025": "11/03/2025", "12-16": "12/16/2025", "12/16": "12/16/2025", "4/15/2025": "4/15/2025"}
    assert each(spark, cases, lambda x: dates.normalize_date(x, 2025)) == list(cases.values())
    assert each(spark, ["4/15/2025"], lambda x: dates.normalize_date(x, 2025, strict=True)) == ["1/15/2025"]


def test_manual_date(spark):
    day = datetime.date(2025, 11, 26)
    cases = {"11/26/2025": day, "11-26-2025": day, "2025-11-26": day, "11/26/25": day, "11-26-25": day, "11/26": day, "11-26": day, "02/29": None, "foo": None, None: None, "": None}
    assert each(spark, cases, lambda x: dates.parse_manual_date(x, 2025)) == list(cases.values())


def test_statement_year_and_file_month(spark):
    cases = {"For billing cycle ending 01/14/2025": 2025, "Statement Closing Date 01/14/25": 2025, "forbilling cycleending 01/14/25": 2025, "none": 1999}
    assert each(spark, cases, lambda x: dates.statement_year(x, 1999)) == list(cases.values())
    assert each(spark, ["a/statement_2025-12-16.pdf", "x.pdf"], dates.file_month) == ["2025-12", None]


def test_amounts(spark):
    got = each(spark, ["A $1,234.50 and 7.05", "none", None], amounts.extract_amounts)
    assert [[float(v) for v in x] for x in got[:2]] == [[1234.5, 7.05], []]


CLEANED = {
    "TARGET #1234 FARGO ND": "Target", "WALMART SUPERCENTER #4352 FARGO": "Walmart", "SQSP* INV165866692": "Squarespace", "CASH APP* JOHN DOE": "Cash App", "BP#9267972HWY 13BP SAVAGE MN": "BP",
    "COWBOYJACKS-APPLEV": "Cowboyjacks", "WL*Steam Purchase": "Steam Purchase", "THE HOME DEPOT #3701 WEST FARGO": "The Home Depot West", "SQ* COFFEE SHOP": "Coffee Shop",
}


def test_merchant_cleaner(spark):
    assert each(spark, CLEANED, names.clean_merchant) == list(CLEANED.values())


def test_camel_split(spark):
    cases = {"THEHOMEDEPOT": "THEHOMEDEPOT", "Cashwise": "Cashwise", "CashWise": "Cash Wise"}
    assert each(spark, cases, names.camel_split) == list(cases.values())


def test_first_keyword_wins(spark):
    ordered = {"Dining": ["deli"], "Transportation": ["gas", "mobil"], "Shopping": ["shop", "amazon"], "Clothing": ["macy"], "Personal": ["barber"], "Healthcare": ["pharmacy"], "Bills": ["gas company"]}
    cases = {"CVS Pharmacy": "Clothing", "Fidelity": "Dining", "Gas Company": "Transportation", "Zzyzx": "Uncategorized", "Barber Shop": "Shopping", "T-Mobile": "Transportation"}
    assert each(spark, cases, lambda x: categorize.category_of(x, ordered)) == list(cases.values())
    assert each(spark, ["Target", "CVS Pharmacy"], lambda x: categorize.category_of(x, keywords.CATEGORIES)) == ["Groceries", "Healthcare"]


@pytest.mark.parametrize(
    "label,category,valid",
    [("", "Uncategorized", True), (None, "Uncategorized", True), ("dining", "Dining", True), ("groceriesw", "Groceries", True), ("pet", "Pets", True), ("donation", "Education", True), ("food", "food", False), ("rent", "rent", False)],
)
def test_label_correction(spark, label, category, valid):
    row = categorize.correct_categories(spark.createDataFrame([(label,)], "label string"), ["Groceries", "Dining", "Pets", "Education"]).first()
    assert (row["category"], row["is_valid"]) == (category, valid)


def test_large_dictionaries(spark):
    """Both ways of a dictionary that is a table, against the chain of conditions; and 10^5 keywords without a nested loop."""
    schema = "cat_order int, category string, kw_order int, keyword string"
    few = [(1, "B", 0, "aab"), (0, "A", 0, "Abcde"), (0, "A", 1, "\u00dcber"), (2, "C", 0, "x"), (2, "C", 1, "bcdefg"), (1, "B", 1, "ABCDE"), (3, "D", 0, None), (None, "E", 0, "q"), (4, "F", 0, "aaaaaa")]
    draw = random.Random(3)
    texts = [None, "", "q", "xx", "\u00fcBER", *["".join(draw.choices("abcdefgX", k=draw.randrange(1, 14))) for _ in range(300)], "aaaaaaaaa", "zaabz"]
    ledger = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "place string, n int")
    chain = {"A": ["Abcde", "\u00dcber"], "B": ["aab", "ABCDE"], "C": ["x", "bcdefg"], "F": ["aaaaaa"]}
    for table, dictionary in ((few, chain), ([*few, (5, "Any", 0, "")], chain | {"Any": [""]}), ([], {})):
        known = {r["n"]: r["category"] for r in categorize.categorize(ledger, dictionary).collect()}
        for most in (100, 0):
            found = categorize.categorize_by_table(ledger, spark.createDataFrame(table, schema), most_sent=most)
            assert {r["n"]: r["category"] for r in found.collect()} == known

    words = spark.range(100_000).selectExpr("cast(id % 50 as int) cat_order", "'c' || id % 50 category", "cast(id as int) kw_order", "'shop ' || id keyword")
    places = spark.range(2_000).selectExpr("'At SHOP ' || id * 61 || ' N' place")
    out = categorize.categorize_by_table(places, words)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        number = r["place"].split()[2]
        inside = {int(number[:n]) for n in range(1, len(number) + 1)}
        first = min((i % 50, i) for i in inside if i < 100_000)
        assert r["category"] == f"c{first[0]}"


DATES = [
    ("42/29/2025", "12/29/2025", "12/29/2025"), ("41/03/2025", "11/03/2025", "11/03/2025"), ("40/1/2025", "10/1/2025", "10/1/2025"), ("14/1/2025", "11/1/2025", "14/1/2025"),
    ("13/1/2025", "11/1/2025", "13/1/2025"), ("22/1/2025", "12/1/2025", "22/1/2025"), ("30/1/2025", "10/1/2025", "30/1/2025"), ("15/1/2025", "15/1/2025", "15/1/2025"),
    ("12-16", "12-16", "12/16/2025"), ("12/16", "12/16", "12/16/2025"), ("4/15/2025", "4/15/2025", "4/15/2025"),
]
HEADS = [
    ("For billing cycle ending 01/14/2025", 2025), ("Statement Closing Date 01/14/25", 2025), ("forbilling cycleending 01/14/24", 2024), ("Statement date: 2/3/2023", 2023), ("nothing", 1999),
]
NAMES = [
    ("TARGET #1234 FARGO ND", "Target"), ("WALMART SUPERCENTER #4352 FARGO", "Walmart"), ("SQSP* INV165866692", "Squarespace"), ("CASH APP* JOHN DOE", "Cash App"),
    ("BP#9267972HWY 13BP SAVAGE MN", "BP"), ("COWBOYJACKS-APPLEV", "Cowboyjacks"), ("WL*Steam Purchase", "Steam Purchase"), ("THE HOME DEPOT #3701 WEST FARGO", "The Home Depot West"),
    ("SQ* COFFEE SHOP", "Coffee Shop"), ("CASHWISE #3045 WEST FARGO ND", "Cashwise West"), ("TST* RESTAURANT NAME MOORHEAD MN", "Tst Name"), ("PIKEAND PINTGRILLINC ALEXANDRIA", "Pikeand"),
    ("$100.00 AT 9:30", "ATM Withdrawal"),
]
PLACES = [
    ("Chase Bankcard Online Pmt X", "Chase Bankcard"), ("CAPITAL ONE CARD CTR PAYMENT", "Credit Card Payment"), ("ford auto loan 123", "Ford Auto Loan"),
    ("ACME LOAN PYMT", "Acme Loan Payment"), ("Wells Financia", "Wells Financial"), ("Shop 01/02/25 At", "Shop"), ("Power Web_Pay 55", "Power"),
]
TITLES = [("O'REILLY 7-ELEVEN", "O'Reilly 7-Eleven"), ("CashWise llc", "Cash Wise LLC"), ("the ATM of bp", "the ATM of BP"), ("to", "to"), ("THEHOMEDEPOT", "Thehomedepot")]
LABELS = [
    ("STEAM PURCHASE", "Steam"), ("The Home Depot", "Home Depot"), ("BP", "BP"), ("CashWise", "Cash Wise"), ("Acme (No location information given)", "Acme"), (", Target Store,", "Target"),
]
ANSWERS = [
    ('"Target"', "TARGET 1", "Target"), ("Output: Home Depot\nbecause", "HD", "Home Depot"), ("SQ *Coffee", "x", "Coffee"), ("The merchant name is X", "x", None), ("ab", "x", None),
    ("Target", "target", None), ("Coborns Merchant: other", "x", "Coborns"),
]
FUZZY = [
    ("groceriesw", "Groceries", True), ("utilites", "Utilities", True), ("travl", "Travel", True), ("insurnce", "Insurance", True), ("healtcare", "Healthcare", True),
    ("pet", "Pets", True), ("donation", "Education", True), ("dining", "Dining", True), ("food", "food", False), ("util", "util", False), ("rent", "rent", False),
    ("resturant", "resturant", False), ("home improvement", "home improvement", False), ("", "Uncategorized", True),
]


@pytest.mark.parametrize(
    "cases,clean",
    [(HEADS, lambda x: dates.statement_year(x, 1999)), (NAMES, names.clean_merchant), (PLACES, names.clean_place), (TITLES, names.smart_title), (LABELS, names.normalize_label)],
    ids=["years", "merchants", "places", "titles", "labels"],
)
def test_known_texts(spark, cases, clean):
    assert each(spark, [*(x for x, _ in cases), None, ""], clean)[: len(cases)] == [y for _, y in cases]


def test_known_dates_and_answers(spark):
    for clean, n in ((dates.repair_month, 1), (lambda x: dates.normalize_date(x, 2025), 2)):
        assert each(spark, [x[0] for x in DATES], clean) == [x[n] for x in DATES]
    rows = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(ANSWERS)], "i int, answer string, original string")
    found = rows.select("i", providers.scrub_answer(F.col("answer"), F.col("original")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in found] == [x[2] for x in ANSWERS]


def test_known_labels(spark):
    found = categorize.correct_categories(spark.createDataFrame([(x[0],) for x in FUZZY], "label string"), texts.CATEGORIES)
    assert sorted(map(tuple, found.collect())) == sorted(FUZZY)


def test_steps_of_cleaners_stand_once_in_the_plan(spark):
    rows = spark.createDataFrame([("TARGET #1234 FARGO ND",)], "x string")
    for clean, step in ((names.clean_merchant, "OIL$"), (names.clean_merchant, "RECUR\\s+PURCHASE"), (names.clean_place, "WEB PMTS"), (names.smart_title, "([a-z])([A-Z])")):
        plan = rows.select(clean(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
        assert plan.count(step) == 1, step
