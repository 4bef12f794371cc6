"""Parsing, reconciliation, transfers, review, files and streams on small ledgers."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import categorize, merchants, reconcile, review, rollup, statements, transfers
from tidemark.plans import monthly
from tidemark.sources import files, sinks
from tidemark.streaming import ingest

STATEMENT = "\n".join(["ACCOUNT ACTIVITY", "01/15/2025 TARGET #1234 FARGO ND $45.10 $1,912.93", "COWBOYJACKS 1/01/25", "01/02/2025 $500.00 $1,412.93", "AT 9:30", "TOTAL DEBITS 545.10"])


def day(text):
    return datetime.datetime.strptime(text, "%m/%d/%Y").date()


def test_parse_with_continuations(spark):
    rows = statements.parse_statements(spark.createDataFrame([("d", STATEMENT)], "doc_id string, text string"), 2025).orderBy("line_no").collect()
    assert [(r["place_original"], r["amount"], r["balance"]) for r in rows] == [
        ("TARGET #1234 FARGO ND COWBOYJACKS 1/01/25", Decimal("45.10"), Decimal("1912.93")), ("COWBOYJACKS 1/01/25 AT 9:30", Decimal("500.00"), Decimal("1412.93")),
    ]


def test_parse_odd_texts(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "no dates here\n\n")], "doc_id string, text string")
    assert statements.parse_statements(df, 2025).count() == 0 and statements.parse_statements(df.limit(0), 2025).count() == 0


def test_tolerant_reconciliation(spark):
    def side(rows):
        return spark.createDataFrame([("d", day(t), Decimal(a), f"P{i}", f"P{i}", i) for i, (t, a) in enumerate(rows)], "doc_id string, txn_date date, amount decimal(12,2), place string, place_original string, ordinal int")

    a = side([("01/05/2025", "10.00"), ("01/05/2025", "10.00"), ("01/06/2025", "7.50")])
    b = side([("01/05/2025", "10.01"), ("01/07/2025", "7.50")])
    rows = reconcile.reconcile_tolerant(a, b).collect()
    assert len(rows) == 4
    counts = {r["extraction_method"]: r["n"] for r in reconcile.reconcile_counts(reconcile.reconcile_tolerant(a, b)).collect()}
    assert sorted(counts.values()) == [1, 1, 2]


def test_transfers_between_accounts(spark):
    rows = [(1, "01/01/2025", "100.00", "X"), (2, "01/03/2025", "100.00", "Y"), (3, "01/03/2025", "100.00", "Y"), (4, "01/10/2025", "100.00", "X"), (5, "01/01/2025", "0.00", "X"), (6, "01/01/2025", "0.00", "Y")]
    ledger = spark.createDataFrame([(i, day(t), Decimal(a), s) for i, t, a, s in rows], "txn_id long, txn_date date, amount decimal(12,2), statement string")
    pairs = transfers.transfer_pairs(ledger)
    assert {(r["id1"], r["id2"]) for r in pairs.collect()} == {(1, 2), (1, 3)}
    left = transfers.without_pairs(ledger, transfers.greedy_pairs(pairs))
    assert {r["txn_id"] for r in left.collect()} == {3, 4, 5, 6}


def test_review(spark):
    schema = "place string, amount decimal(12,2), category string, classification string, uncategorized boolean"
    rows = spark.createDataFrame([("A", Decimal(1), "Dining", " expense ", True), ("B", Decimal(2), None, "INCOME", True), ("C", Decimal(3), None, "", False), ("D", Decimal(4), None, None, False)], schema)
    ledger = rows.drop("classification", "uncategorized").limit(0)
    done = review.apply_review(ledger, ledger, rows)
    assert {k: sorted(r["place"] for r in v.collect()) for k, v in done.items()} == {"expenses": ["A"], "income": ["B"], "review": ["C", "D"]}


def test_a_month_from_texts(spark):
    texts = spark.createDataFrame([("d", x, f"STEARNSBANK.COM\nchecking\n{STATEMENT}", "2025-01") for x in "AB"], "doc_id string, extractor string, text string, month string")
    settings = monthly.Settings(2025)
    out = monthly.build_month(monthly.parse_month(texts, settings), settings)
    assert sum(v.count() for v in out.values()) == 2


def test_credits_unreadable_dates_and_equal_purchases(spark):
    lines = ["STEARNSBANK.COM", "CHECKING ACCOUNT", "ACCOUNT ACTIVITY", "01/05/2025 ACME PAY $0.00 $900.00 $1,000.00", "01/06/2025 CORNER COFFEE $4.50", "01/06/2025 CORNER COFFEE $4.50", "02/31/2025 PLAIN SHOP $7.00"]
    texts = spark.createDataFrame([("d", x, "\n".join(lines), "2025-01") for x in "AB"], "doc_id string, extractor string, text string, month string")
    for strict in (False, True):
        rows = monthly.parse_month(texts, monthly.Settings(2025, strict=strict)).orderBy("txn_id").collect()
        assert [(r["type"], r["extraction_method"], r["credits"]) for r in rows] == [("Income", "A+B", Decimal("900.00")), ("Expense", "A+B", None), ("Expense", "A+B", None), ("Expense", "A+B", None)]
        assert len({r["txn_id"] for r in rows}) == 4 and [r["line_no"] for r in rows] == [3, 4, 5, 6] and rows[3]["txn_date"] is None


def statement(*lines):
    return "\n".join(["STEARNSBANK.COM", "CHECKING ACCOUNT", "ACCOUNT ACTIVITY", *lines])


def texts_of(spark, *lines, month="2025-01"):
    return spark.createDataFrame([("d" + month, x, statement(*lines), month) for x in "AB"], "doc_id string, extractor string, text string, month string")


HAND = "date string, place string, amount string, category string"


def test_three_closings_lose_and_reopen_nothing(spark, tmp_path):
    texts = texts_of(spark, "01/05/2025 ACME PAY $0.00 $900.00 $1,000.00", "01/06/2025 NETFLIX $4.50", "01/07/2025 VENMO JOHN $5.00", "01/08/2025 ZZYZX QQ $7.00")
    settings, root, cache, words = monthly.Settings(2025, categories={"Fun": ["netflix"], "Dining": ["diner"]}), str(tmp_path / "out"), str(tmp_path / "cache"), str(tmp_path / "words")
    store = sinks.MonthStore(spark, root, "2025-01")

    def by_hand(*rows):
        return review.manual_entries(spark.createDataFrame(list(rows), HAND), "2025-01", list(settings.categories))

    def read(name):
        return sorted((r["place"], r["category"], str(r["amount"])) for r in store.read(name, "place string, category string, amount decimal(12,2)").collect())

    def close(texts=None, entries=None, reviewed=None):
        return monthly.close_month(texts, "2025-01", root, settings, cache, entries, reviewed, words)

    assert close(texts, by_hand(("01/09/2025", "Corner Netflix", "-3.00", "dinning"), ("02/09/2025", "Late", "1.00", "Fun"), ("x", "Bad", "1.00", "Fun"), ("1/10/25", "Unknown", "2.00", None))) == {"expenses": True, "income": True, "review": True}
    first = [("Corner Netflix", "Dining", "-3.00"), ("Netflix", "Fun", "4.50")]
    assert read("expenses") == first and len(read("income")) == 1 and len(read("review")) == 3
    opened = store.read("review", sinks_schema())
    opened = spark.createDataFrame(opened.collect(), opened.schema)  # as a file that someone keeps
    decided = opened.withColumn("classification", F.when(F.col("place").contains("Venmo"), "income").otherwise(F.when(F.col("place").contains("Zz"), "EXPENSE"))).withColumn("category", F.lit("fun"))
    assert close(reviewed=decided)["review"]  # the entry without a category is still open
    second = sorted([*first, ("Zzyzx", "Fun", "7.00")])
    assert read("expenses") == second and len(read("income")) == 2 and [r[0] for r in read("review")] == ["Unknown"]
    assert close(entries=by_hand(("1/10/25", "Unknown", "2.00", "Fun"), ("01/11/2025", "Other Diner", "6.00", "Dining"))) == {"expenses": True, "income": True, "review": False}
    third = sorted([*second, ("Other Diner", "Dining", "6.00"), ("Unknown", "Fun", "2.00")])
    assert read("expenses") == third and len(read("income")) == 2 and read("review") == []
    assert close(texts, reviewed=opened) == {"expenses": True, "income": True, "review": False}  # an old review, still blank, reopens nothing
    assert read("expenses") == third and len(read("income")) == 2
    assert len(list((tmp_path / "out" / "2025-01" / "versions").iterdir())) == 2
    assert monthly.close_month(texts, "2025-01", root, settings, cache, rebuild=False) == {} and read("expenses") == third
    assert ("Fun", "zzyzx") in {tuple(r) for r in sinks.read_dictionary(spark, words, "category string, keyword string").collect()}


def sinks_schema():
    from tidemark.schema import REVIEW

    return REVIEW


def test_what_people_teach_counts_in_the_same_run(spark, tmp_path):
    settings, root, cache, words = monthly.Settings(2025, categories={"Fun": ["netflix"]}), str(tmp_path / "out"), str(tmp_path / "cache"), str(tmp_path / "words")
    lines = ("01/06/2025 CORNER SHOP $4.50", "01/07/2025 CORNER SHOP $5.50")
    monthly.close_month(texts_of(spark, *lines), "2025-01", root, settings, cache, keywords_path=words)
    store = sinks.MonthStore(spark, root, "2025-01")
    opened = store.read("review", sinks_schema())
    assert opened.count() == 2
    one = opened.where("amount = 4.50").withColumns({"classification": F.lit("Expense"), "category": F.lit("Fun")})
    monthly.close_month(None, "2025-01", root, settings, cache, reviewed=one, keywords_path=words)
    # The keyword taught by one row takes the other one too, at once.
    assert store.read("expenses", "amount decimal(12,2)").count() == 2 and store.read("review", "place string").count() == 0
    # The next month knows the keyword; a name corrected in an old month goes before the cache.
    sinks.write_dictionary(spark.createDataFrame([("CORNER SHOP", "Wrong Name")], "cache_key string, place string"), cache)
    monthly.close_month(texts_of(spark, "02/06/2025 CORNER SHOP $1.00", month="2025-02"), "2025-02", root, settings, cache, keywords_path=words)
    rows = sinks.MonthStore(spark, root, "2025-02").read("expenses", "place string").collect()
    assert [(r["place"], r["category"]) for r in rows] == [("Corner Shop", "Fun")]


def test_a_month_changes_as_a_whole(spark, tmp_path, monkeypatch):
    settings, root, cache = monthly.Settings(2025), str(tmp_path / "out"), str(tmp_path / "cache")
    store = sinks.MonthStore(spark, root, "2025-01")
    assert store.current() is None and store.read("expenses", "place string").count() == 0
    monthly.close_month(texts_of(spark, "01/05/2025 ACME PAY $0.00 $900.00 $1,000.00", "01/06/2025 TARGET $4.50"), "2025-01", root, settings, cache)
    before = store.current()
    assert store.read("income", "place string").count() == 1

    def fail(*args, **more):
        raise RuntimeError("full disk")

    monkeypatch.setattr(sinks, "order_columns", fail)
    try:
        monthly.close_month(texts_of(spark, "01/06/2025 OTHER $1.00"), "2025-01", root, settings, cache)
        raise AssertionError("it should have failed")
    except RuntimeError:
        assert store.current() == before and store.read("income", "place string").count() == 1
    monkeypatch.undo()
    # Without rows expenses are there, with their header, and what the run before left of income is not.
    assert monthly.close_month(texts_of(spark, "nothing"), "2025-01", root, settings, cache) == {"expenses": True, "income": False, "review": False}
    rows = store.read("expenses", "place string")
    assert rows.count() == 0 and "place" in rows.columns and rows.columns[:4] == ["txn_date", "place", "amount", "statement"] and store.read("income", "place string").count() == 0


def test_the_cache_follows_a_stream(spark, tmp_path):
    inbox, cache, marks = tmp_path / "in", str(tmp_path / "cache"), str(tmp_path / "marks")
    for n, names in enumerate((["Corner Shop"], ["CORNER SHOP", "Other"], ["Third"])):
        spark.createDataFrame([(x, n) for x in names], "place string, ordinal int").coalesce(1).write.mode("append").parquet(str(inbox))
        ingest.follow_merchants(spark.readStream.schema("place string, ordinal int").parquet(str(inbox)), cache, marks).awaitTermination()
    got = {r["cache_key"]: r["place"] for r in spark.read.parquet(f"{cache}/2").collect()}
    assert got == {"CORNER SHOP": "CORNER SHOP", "OTHER": "Other", "THIRD": "Third"}
    assert not (tmp_path / "cache" / "0").exists()


def test_names_of_account_holders(spark):
    raw = spark.createDataFrame([("JANE CORNER SHOP",)], "x string")
    assert raw.select(names.clean_merchant(F.col("x"), ("jane",))).first()[0] == "Corner Shop" and raw.select(names.clean_merchant(F.col("x"))).first()[0] == "Jane Corner Shop"


def test_history_of_all_months(spark, tmp_path):
    for month, name, rows in (("2025-01", "expenses.csv", "01/02/2025,Shop,1\n01/03/2025,SHOP,1\n"), ("2025-02", "income.csv", "02/02/2025,shop,1\n"), ("2025-02", "other.csv", "x,y,z\n")):
        (tmp_path / month).mkdir(exist_ok=True)
        (tmp_path / month / name).write_text(f"Transaction Date,Place,Amount\n{rows}")
    rows = files.read_history(spark, str(tmp_path))
    assert sorted(r["place"] for r in rows.collect()) == ["SHOP", "Shop", "shop"]
    assert [tuple(r) for r in merchants.learn_names(rows).collect()] == [("SHOP", "shop")]


def test_files_and_months(spark, tmp_path):
    for month, rows in (("2025-01", "01/02/2025,Shop,12.50,Bank,Dining\n"), ("2025-02", "02/02/2025,Other,bad,Bank,\n")):
        (tmp_path / month).mkdir()
        (tmp_path / month / "expenses.csv").write_text(f"Transaction Date,Place,Amount,Statement,category\n{rows}")
    (tmp_path / "2025-02" / "manual.csv").write_text("# one\n  # two\nTransaction Date,Place,Amount,category,Statement\n02/03/2025,Hand,-3.00,Dining,\n")
    ledger = files.read_ledgers(spark, str(tmp_path))
    assert {(r["month"], r["place"], r["amount"]) for r in ledger.collect()} == {("2025-01", "Shop", Decimal("12.50")), ("2025-02", "Other", Decimal("0.00"))}
    assert [r["place"] for r in files.select_month(ledger, "latest").collect()] == ["Other"]
    by_hand = files.read_ledgers(spark, str(tmp_path), "manual.csv", skip_comments=True).collect()
    assert [(r["place"], r["amount"]) for r in by_hand] == [("Hand", Decimal("-3.00"))]
    out = str(tmp_path / "out")
    sinks.write_months(ledger, out)
    sinks.write_months(ledger.where("month = '2025-01'").withColumn("place", F.lit("New")), out)
    assert {r["place"] for r in spark.read.parquet(out).collect()} == {"New", "Other"}
    sinks.write_months(ledger, out, rebuild=False)
    assert spark.read.parquet(out).count() == 2


def test_streams_find_what_a_batch_finds(spark, tmp_path):
    inbox, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    inbox.mkdir()
    for i in range(2):
        (inbox / f"s{i}.txt").write_text(f"{STATEMENT}\nfile {i}")
        ingest.ingest_new(spark, str(inbox), out, marks, 2025).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    events = spark.createDataFrame([(datetime.datetime(2025, 1, d), "X", 1.0) for d in (1, 2, 3)], "ts timestamp, statement string, amount double")
    assert ingest.monthly_spending(events).agg(F.sum("n")).first()[0] == 3


def test_tolerant_reconciliation_against_a_plain_walk(spark):
    rng = random.Random(8)
    days = [day("01/05/2025"), day("01/06/2025"), None]

    def side(n):
        rows = [(rng.choice(["d", None]), rng.choice(days), rng.choice([None, Decimal(f'1.0{rng.randint(0, 6)}')]), rng.choice([None, Decimal("1.04")]), f"P{i}", f"P{i}", i) for i in range(n)]
        return rows, spark.createDataFrame(rows, "doc_id string, txn_date date, amount decimal(12,2), debits decimal(12,2), place string, place_original string, ordinal int")

    (left, a), (right, b) = side(150), side(120)
    free, expected = list(right), []
    for x in left:
        amount = x[2] if x[2] is not None else x[3]
        hit = next((y for y in free if y[:2] == x[:2] and amount is not None and (v := y[2] if y[2] is not None else y[3]) is not None and abs(v - amount) <= Decimal("0.01")), None)
        if hit:
            free.remove(hit)
        expected.append((x[0], x[1], amount, "A+B" if hit else "A only"))
    expected += [(y[0], y[1], y[2] if y[2] is not None else y[3], "B only") for y in free]
    got = [(r["doc_id"], r["txn_date"], r["amount"], r["extraction_method"]) for r in reconcile.reconcile_tolerant(a, b).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len({m for *_, m in got}) == 3
    # Equal doubles of strict ledgers, some of whose gaps of two cents count as near; and many equal rows.
    many = [spark.range(20_000).selectExpr("'d' as doc_id", "date'2025-01-05' as txn_date", f"cast(1.0{i} as decimal(12,2)) as amount", "'p' as place", "'p' as place_original", "cast(id as int) as ordinal") for i in (0, 1)]
    counts = {r["extraction_method"]: r["n"] for r in reconcile.reconcile_counts(reconcile.reconcile_tolerant(*many, strict=True)).collect()}
    assert counts == {"A+B": 20_000}


def test_greedy_pairs_against_a_walk(spark):
    rng = random.Random(9)
    pairs = {(a, b) for a, b in ((rng.randint(0, 60), rng.randint(0, 60)) for _ in range(220)) if a < b} | {(100 + i, 101 + i) for i in range(9)}
    used, expected = set(), []
    for a, b in sorted(pairs):
        if not {a, b} & used:
            used |= {a, b}
            expected.append((a, b))
    df = spark.createDataFrame(sorted(pairs), "id1 long, id2 long").repartition(3)
    assert sorted(tuple(r) for r in transfers.greedy_pairs(df).collect()) == expected
    assert transfers.greedy_pairs(df.limit(0)).count() == 0


def crowded(spark, seed, n_days, ids=10_000):
    """Few amounts, days and accounts, so that many rows wait for one another; ids in an order of their own."""
    rng = random.Random(seed)
    rows = [(rng.randrange(ids) if ids < 10_000 else i, day("01/01/2025") + datetime.timedelta(rng.randrange(n_days)), Decimal(rng.randrange(3)), rng.choice("ABC")) for i in range(200)]
    rows += [(None, day("01/01/2025"), Decimal(1), "A"), (20_000, None, Decimal(1), "B"), (20_001, day("01/01/2025"), Decimal(1), None), (20_002, day("01/01/2025"), None, "C")]
    pairs = {(a[0], b[0], a[2]) for a in rows for b in rows if None not in (*a, *b) and a[2] == b[2] > 0 and a[0] < b[0] and a[3] != b[3] and abs((a[1] - b[1]).days) <= 2}
    return spark.createDataFrame(rows, "txn_id long, txn_date date, amount decimal(12,2), statement string").repartition(3), sorted(pairs)


def test_greedy_transfers_against_a_walk(spark):
    for seed, n_days, ids in ((1, 1, 10_000), (2, 20, 10_000), (3, 6, 90)):  # the last has ids that repeat
        ledger, pairs = crowded(spark, seed, n_days, ids)
        used, expected = set(), []
        for a, b, amount in pairs:
            if not {(a, amount), (b, amount)} & used:
                used |= {(a, amount), (b, amount)}
                expected.append((a, b))
        assert sorted(map(tuple, transfers.greedy_transfers(ledger).collect())) == sorted(expected)
    assert transfers.greedy_transfers(ledger.limit(0)).count() == 0


def test_mutual_transfers_against_listed_pairs(spark):
    for seed, n_days, ids in ((1, 4, 10_000), (3, 6, 90)):
        ledger, pairs = crowded(spark, seed, n_days, ids)
        first, second = {}, {}
        for a, b, _ in pairs:
            first[a], second[b] = min(b, first.get(a, b)), min(a, second.get(b, a))
        assert sorted(map(tuple, transfers.mutual_transfers(ledger).collect())) == sorted((a, b) for a, b in first.items() if second[b] == a)


def test_a_month_without_listed_pairs(spark, monkeypatch):
    """One day of one amount in three accounts: its transfers go, and no step lists all pairs or tries them in rounds."""
    for name in ("transfer_pairs", "greedy_pairs"):
        monkeypatch.setattr(transfers, name, lambda *a: pytest.fail("pairs are listed"))
    rows = spark.range(80).selectExpr("id as txn_id", "date'2025-01-05' as txn_date", "10.00BD as amount", "'corner ' || id as place", "'Income' as type", "concat('a', id % 10 div 4) as account_id")
    out = monthly.build_month(rows, monthly.Settings(2025))
    assert out["income"].count() == 0


def test_streamed_batches_replace_what_they_left(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "s.txt").write_text(STATEMENT)
    for marks in ("a", "b"):  # the second run has lost its marks and does the first batch again
        ingest.ingest_new(spark, str(inbox), out, str(tmp_path / marks), 2025).awaitTermination()
    assert spark.read.parquet(out).count() == 2


class Adviser:
    """Answers by what a prompt has in it, and notes each prompt in a file."""

    def __init__(self, answers, path):
        self.answers, self.path = answers, str(path)

    def answer(self, inputs):
        with open(self.path, "a") as notes:
            notes.writelines(x.splitlines()[0] + "|" + x.splitlines()[1] + "\n" for x in inputs)
        return inputs.map(lambda x: next((a for part, a in self.answers.items() if part in x), None))


def test_an_adviser_where_rules_do_not_tell(spark, tmp_path):
    texts = texts_of(spark, "01/05/2025 VENMO PAYROLL BOB $1.00", "01/06/2025 NETFLIX $4.50", "01/07/2025 VENMO JOHN $5.00", "01/08/2025 VENMO ANNE $6.00", "01/09/2025 ZZYZX QQ $7.00",
                     "01/10/2025 WIDGET BARN $8.00", "01/11/2025 WIDGET BARN $8.00")
    adviser = Adviser({"JOHN": "That is income.", "ANNE": "unclear", "Widget": " fun ", "Zzyzx": "Fun."}, tmp_path / "asked")
    settings = monthly.Settings(2025, categories={"Fun": ["netflix"], "Dining": ["diner"]}, adviser=adviser)
    out = {name: sorted((r["place"].split()[-1].lower(), r["category"]) for r in rows.collect()) for name, rows in monthly.build_month(monthly.parse_month(texts, settings), settings).items()}
    assert [p for p, _ in out["income"]] == ["bob", "john"]
    assert out["expenses"] == [("barn", "Fun"), ("barn", "Fun"), ("netflix", "Fun")]
    assert [p for p, _ in out["review"]] == ["anne", "zzyzx"]
    asked = (tmp_path / "asked").read_text().splitlines()
    assert len(asked) == len(set(asked)) and sum("income or an expense" in x for x in asked) == 2 and sum("Widget" in x for x in asked) == 1
    plain = monthly.Settings(2025, categories=settings.categories)
    assert [r["place"].split()[-1].lower() for r in monthly.build_month(monthly.parse_month(texts, plain), plain)["income"].collect()] == ["bob"]


def test_labels_by_an_adviser(spark, tmp_path):
    labels = spark.createDataFrame([("food",), ("travl",), ("pets",), ("xyz",), (" ",), (None,), ("utilites",)], "label string")
    adviser = Adviser({"food": "dining.", "travl": "no idea", "utilites": "Pets"}, tmp_path / "asked")
    found = categorize.correct_categories(labels, ["Dining", "Travel", "Pets", "Utilities"], provider=adviser)
    assert {r["label"]: (r["category"], r["is_valid"]) for r in found.collect()} == {
        "food": ("Dining", True), "travl": ("Travel", True), "pets": ("Pets", True), "xyz": ("xyz", False), " ": ("Uncategorized", True), None: ("Uncategorized", True), "utilites": ("Pets", True)
    }
    assert len((tmp_path / "asked").read_text().splitlines()) == 4


def test_dates_as_printed(spark):
    rows = spark.createDataFrame([("10/02/2025", day("10/02/2025")), ("2/1/2025", day("02/01/2025")), (None, None), ("x", None)], "txn_date_raw string, txn_date date")
    assert [r["txn_date_raw"] for r in rollup.chronological(rows, strict=True).collect()] == [None, "10/02/2025", "2/1/2025", "x"]
    assert [r["txn_date_raw"] for r in rollup.chronological(rows, "txn_date_raw").collect()] == ["2/1/2025", "10/02/2025", None, "x"]
    assert rollup.order_columns(rows.withColumns({"n": F.lit(1), "amount": F.lit(2)})).columns == ["txn_date", "amount", "txn_date_raw", "n"]


def test_two_extractions_meet_in_one_shuffle(spark):
    cols = "doc_id string, txn_date_raw string, ordinal int, amount decimal(12,2), debits decimal(12,2), credits decimal(12,2), place string, place_original string"
    a = [("d", "01/02/2025", 1, 5, None, None, "p", "Shop"), ("d", "01/02/2025", 2, 5, None, None, "p", "POS PURCHASE"), ("d", None, 3, None, 7, None, "q", "Bar"), ("d", None, 4, None, None, None, "r", "None"), ("e", "x", 1, 1, None, None, "s", "Only")]
    b = [("d", "01/02/2025", 8, 5, None, None, "t", "Shop"), ("d", "01/02/2025", 9, 5, None, None, "u", "Shop two"), ("d", None, 1, 7, None, None, "v", "Bar"), ("d", None, 2, None, None, None, "w", None), ("d", None, 3, 7, None, None, "y", "Late")]
    sides = [spark.createDataFrame([tuple(Decimal(v) if v is not None and 3 <= i <= 5 else v for i, v in enumerate(r)) for r in rows], cols) for rows in (a, b)]
    out = reconcile.reconcile(*sides, keys=("doc_id", "txn_date_raw"), carry=("ordinal", "debits", "credits"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted((str(r["txn_date_raw"]), r["ordinal"], r["place"], str(r["place_original"]), r["extraction_method"]) for r in out.collect())
    assert got == [
        ("01/02/2025", 1, "p", "Shop", "A+B"), ("01/02/2025", 2, "u", "Shop two", "A+B"), ("None", 3, "q", "Bar", "A+B"), ("None", 3, "y", "Late", "B only"),
        ("None", 4, "r", "None", "A+B"), ("x", 1, "s", "Only", "A only"),
    ]
