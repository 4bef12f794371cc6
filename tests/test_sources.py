"""Readers of settings, answers of providers, votes and formats."""

import json
import random
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import amounts, names, scoring
from tidemark.operators import ensemble, merchants, rollup
from tidemark.sources import files, keywords, providers, sinks


class Fixed:
    def answer(self, inputs: pd.Series) -> pd.Series:
        return inputs.map(lambda x: None if x is None else f"{x}!")


def test_amount_in_lower_case(spark, tmp_path):
    (tmp_path / "lower" / "2025-01").mkdir(parents=True)
    (tmp_path / "lower" / "2025-01" / "income.csv").write_text("Transaction Date,Place,amount\n01/02/2025,A,5\n")
    assert [r["amount"] for r in files.read_ledgers(spark, str(tmp_path / "lower"), "income.csv").collect()] == [Decimal("5.00")]


def test_two_amount_columns(spark, tmp_path):
    for header in ("amount,Amount", "Amount,amount"):
        folder = tmp_path / header / "2025-01"
        folder.mkdir(parents=True)
        first = header.startswith("Amount")
        (folder / "income.csv").write_text(f"Transaction Date,Place,{header}\n01/02/2025,A,{'5,7' if first else '7,5'}\n01/03/2025,B,{'x,7' if first else '7,x'}\n")
        got = {r["place"]: r["amount"] for r in files.read_ledgers(spark, str(tmp_path / header), "income.csv").collect()}
        assert got == {"A": Decimal("5.00"), "B": Decimal("0.00")}


def test_settings_files(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"words": ["x", "y"], "categories": {"B": ["b"], "A": ["a", "c"]}}))
    assert keywords.read_keywords(spark, str(path), "words") == ["x", "y"] and keywords.read_keywords(spark, str(path), "none", ["d"]) == ["d"]
    assert keywords.read_keywords(spark, str(tmp_path / "gone.json"), "words", ["d"]) == ["d"]
    assert list(keywords.read_categories(spark, str(path))) == ["B", "A"] and len(keywords.read_categories(spark, str(tmp_path / "gone.json"))) == 6
    assert [tuple(r) for r in keywords.category_table(spark, keywords.read_categories(spark, str(path))).collect()] == [(0, "B", 0, "b"), (1, "A", 0, "a"), (1, "A", 1, "c")]


def test_providers_and_labels(spark):
    rows = spark.createDataFrame([("Dining.;",), ("dining",), ("other",), (None,)], "x string")
    assert [r[0] for r in rows.select(providers.match_label(F.col("x"), ["Dining", "Gas"])).collect()] == ["Dining", "Dining", None, None]
    assert [r[0] for r in rows.select(providers.ask(F.col("x"), Fixed())).collect()] == ["Dining.;!", "dining!", "other!", None]
    assert [r[0] for r in rows.select(providers.ask(F.col("x"))).collect()] == [None] * 4
    said = spark.createDataFrame([("It is INCOME, not expense",), ("expense",), ("",), (None,)], "x string")
    assert [r[0] for r in said.select(providers.income_or_expense(F.col("x"))).collect()] == ["income", "expense", "expense", "expense"]


def test_votes(spark):
    rows = [("a", "Shop", 1, 60), ("a", "SHOP", 2, 90), ("b", "Corner Shop", 1, 60), ("b", "POS X", 2, 60)]
    won = scoring.weighted_vote(spark.createDataFrame(rows, "k string, result string, prompt int, confidence int"), ["k"])
    assert {r["k"]: (r["winner"], r["unanimous"]) for r in won.collect()} == {"a": ("Shop", True), "b": ("Corner Shop", False)}


def test_formats_and_counts(spark):
    rows = spark.createDataFrame([("s", "Income", Decimal("1234.50")), ("s", "Income", Decimal("-3.00")), ("t", "Expense", None)], "statement string, type string, amount decimal(12,2)")
    assert [r[0] for r in rows.select(amounts.as_currency(F.col("amount"))).collect()] == ["$1,234.50", "-$3.00", None]
    assert {tuple(r) for r in rollup.statement_counts(rows).collect()} == {("s", "Income", 2), ("t", "Expense", 1)}
    pairs = spark.createDataFrame([("The Corner & Shop", "cornershop fargo"), ("A1", "B1")], "a string, b string")
    assert [r[0] for r in pairs.select(names.same_merchant(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_every_month_by_its_own_header(spark, tmp_path):
    months = {
        "2025-01": "Transaction Date,Place,Amount,Statement,category\n01/02/2025,Shop,12.50,Bank,Dining\n",
        "2025-02": "\ufeffAmount,category,Place,Transaction Date\r\n7.25,Fun,Second Shop,02/03/2025\r\n",
        "2025-03": "place,AMOUNT,extra\nThird Shop,1.00,x\n", "2025-04": "\n", "2025-05": "\x00\x01 no ledger\nx,y\n", "2025-06": "Place\nOnly Place\n",
        "2025-07": 'Transaction Date,Place,Amount\n07/01/2025,"Last, Shop",2.00,too,many\n',
    }
    for month, text in months.items():
        (tmp_path / month).mkdir()
        (tmp_path / month / "expenses.csv").write_bytes(text.encode())
    got = {r["month"]: r for r in files.read_ledgers(spark, str(tmp_path)).collect()}
    assert {m: (r["place"], str(r["amount"])) for m, r in got.items()} == {
        "2025-01": ("Shop", "12.50"), "2025-02": ("Second Shop", "7.25"), "2025-03": ("Third Shop", "1.00"), "2025-06": ("Only Place", "0.00"), "2025-07": ("Last, Shop", "2.00"),
    }
    assert str(got["2025-02"]["txn_date"]) == "2025-02-03" and got["2025-02"]["category"] == "Fun" and got["2025-03"]["txn_date"] is None
    report = {r["month"]: r["problem"] for r in files.ledger_files(spark, str(tmp_path), "expenses.csv").collect()}
    assert report == {**dict.fromkeys(months), "2025-04": "empty", "2025-05": "no known column"}
    assert sorted(r["place"] for r in files.read_history(spark, str(tmp_path)).collect()) == ["Last, Shop", "Only Place", "Second Shop", "Shop", "Third Shop"]
    assert files.read_ledgers(spark, str(tmp_path), "none.csv").count() == 0


def test_hand_written_entries_by_their_own_header(spark, tmp_path):
    for month, text in (("2025-01", "# note\n  # more\n\nTransaction Date,Place,category,Amount\n01/05/2025,Hand,Fun,3.00\n# end\n"), ("2025-02", "# only\nAmount,Place\n4.00,Two\n"), ("2025-03", "# nothing\n")):
        (tmp_path / month).mkdir()
        (tmp_path / month / "manual.csv").write_text(text)
    rows = files.read_ledgers(spark, str(tmp_path), "manual.csv", skip_comments=True).collect()
    assert sorted((r["month"], r["place"], str(r["amount"]), r["category"]) for r in rows) == [("2025-01", "Hand", "3.00", "Fun"), ("2025-02", "Two", "4.00", None)]


class Stub:
    """Answers by a table of (prompt's first word, name), and notes each call in a file."""

    def __init__(self, log: str):
        self.log = log

    def complete(self, prompts: pd.Series, model: str, temperature: float) -> pd.Series:
        def one(prompt: str):
            first, name = prompt.split(" ", 1)[0], prompt.split("\n")[1].split(": ", 1)[1]
            with open(self.log, "a") as f:
                f.write(f"{first}/{model}/{temperature}/{name}\n")
            return {("Which", "SHOP 1"): "Corner Shop", ("Give", "SHOP 1"): "corner shop", ("Is", "SHOP 1"): "Corner Shop", ("Which", "POS X"): "POS Purchase", ("Give", "POS X"): "Big Store"}.get((first, name))

        return prompts.map(one)


def test_a_series_of_prompts_is_asked_once_and_voted_on(spark, tmp_path):
    log = tmp_path / "calls"
    series = ensemble.PromptSeries(Stub(str(log)), ("large", "small", "large"), store=str(tmp_path / "answers"))
    names_ = spark.createDataFrame([("SHOP 1",), ("SHOP 1",), ("POS X",), ("mute",), (None,)], "name string")
    won = {r["name"]: (r["place"], r["unanimous"]) for r in ensemble.names_by_series(names_, series).collect()}
    assert won == {"SHOP 1": ("Corner Shop", True), "POS X": ("Big Store", False)}
    calls = log.read_text().splitlines()
    assert sorted(calls) == sorted(f"{p}/{m}/{t}/{n}" for p, m, t in (("Which", "large", 0.0), ("Give", "small", 0.0), ("Is", "large", 0.1)) for n in ("SHOP 1", "POS X", "mute"))
    assert {r["name"]: (r["place"], r["unanimous"]) for r in ensemble.names_by_series(names_.where("name <> 'mute'"), series).collect()} == won
    again = log.read_text().splitlines()[len(calls) :]
    assert again == ["Is/large/0.1/POS X"]  # the one question that had no answer
    ledger = spark.createDataFrame([("SHOP 1",), ("POS X",)], "place_original string")
    cleaned = merchants.clean_names(ledger.where("place_original = 'SHOP 1'"), None, ensemble.PromptSeries(Stub(str(log)), ("large", "small", "large")))
    assert [r["place_original"] for r in cleaned.collect()] == ["SHOP 1"]


def read_in_order(words, x0, y0, x1, y1, share=0.5):
    """Brute force: words (text, x, y, width, height) inside a region, by lines."""
    lines = []
    for text, x, y, w, h in sorted(words, key=lambda w: (2 * w[2] + w[4], w[1], w[2], w[2] + w[4], w[0].strip())):
        across, down = min(x + w, x1) - max(x, x0), min(y + h, y1) - max(y, y0)
        if not text.strip() or across <= 0 or down <= 0 or across * down < share * w * h:
            continue
        both = min(lines[-1][1], y + h) - max(lines[-1][0], y) if lines else 0
        if both > 0 and 2 * both >= min(lines[-1][1] - lines[-1][0], h):
            lines[-1][2].append((x, 2 * y + h, text.strip()))
        else:
            lines.append((y, y + h, [(x, 2 * y + h, text.strip())]))
    return "\n".join(" ".join(w[2] for w in sorted(line)) for _, _, line in lines)


def test_region_in_reading_order(spark):
    draw = random.Random(5)
    pages = [(i, [(draw.choice(["a", "bb ", "c", " "]), draw.randrange(90), draw.randrange(60), draw.randrange(1, 30), draw.randrange(1, 14), 0.9) for _ in range(draw.randrange(25))]) for i in range(60)]
    rows = spark.createDataFrame([*pages, (60, None)], f"id int, boxes {providers.WORD_BOXES}")
    for box, padding in (((10, 5, 70, 50), 0), ((-20, -3, 200, 55), 2), ((0, 0, 100, 60), 0)):
        edges = [F.lit(n) for n in (*box, 100, 60)]
        found = {r["id"]: r["text"] for r in rows.select("id", providers.region_text(F.col("boxes"), *edges, padding=padding).alias("text")).collect()}
        inner = max(0, box[0] + padding), max(0, box[1] + padding), min(100, box[2] - padding), min(60, box[3] - padding)
        assert found == {i: read_in_order([w[:5] for w in words], *inner) for i, words in pages} | {60: ""}
    none = rows.select(providers.cell_text(F.col("boxes"), F.lit(5), F.lit(5), F.lit(9), F.lit(50), F.lit(100), F.lit(60)).alias("thin"),
                       providers.region_text(F.col("boxes"), F.lit(None).cast("int"), *[F.lit(50)] * 5).alias("unknown")).distinct().collect()
    assert [tuple(r) for r in none] == [("", "")]


def test_texts_of_documents_and_json(spark, tmp_path):
    for name, content in (("2025-01/b.pdf", b"two"), ("2025-01/a.pdf", b"one"), ("2025-02/c.pdf", b"three"), ("2025-01/notes.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)

    class Reader:
        def answer(self, inputs):
            return inputs.map(lambda content: {b"one": "first"}.get(bytes(content)))

    found = files.read_statements(spark, str(tmp_path))
    assert [(r["path"].split("/")[-1], r["month"], r["length"]) for r in found.orderBy("path").collect()] == [("a.pdf", "2025-01", 3), ("b.pdf", "2025-01", 3), ("c.pdf", "2025-02", 5)]
    texts = providers.extract_text(found, digital=Reader()).join(found.select("doc_id", "month"), "doc_id")
    assert sorted(tuple(r) for r in texts.select("month", "extractor", "text").collect()) == [
        ("2025-01", "A", ""), ("2025-01", "A", "first"), ("2025-01", "B", ""), ("2025-01", "B", ""), ("2025-02", "A", ""), ("2025-02", "B", "")
    ]
    assert [r["json"] for r in sinks.as_json(spark.createDataFrame([(1, "x", None)], "n int, place string, amount double")).collect()] == ['{"n":1,"place":"x"}']
