"""The parser's walk in chunks against a walk over all lines in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import statements as S

PIECES = [
    "01/15/2025 TARGET #1234 FARGO ND $45.10 $1,912.93", "1/2/25 COFFEE SHOP 4.50", "01-05 GAS STATION 30.00", "01/02/2025 $500.00 $1,412.93", "01/02/2025", "COWBOYJACKS 1/01/25", "AT 9:30",
    "plain words", "", "   ", "ACCOUNT ACTIVITY", "TOTAL DEBITS 5.00", "BEGINNING BALANCE 7.00", "$9.99", "12:30", "POST DATE DESCRIPTION", "PAGE 2", "3/4", "12345678901234567890 X 1.00", "01/31/2025 A B 1.00 2.00 3.00",
]


def heads(text: str) -> list[int]:
    """The lines where transactions may begin."""
    lines = [x.strip(" ") for x in text.split("\n")]
    at = lambda i: lines[i] if i < len(lines) else ""
    any_of = lambda line, words: any(w in line.upper() for w in words)
    dated = lambda line: bool(re.match(r"\d{1,2}/\d{1,2}/\d{2}|\d{1,2}-\d{1,2}\s", line))
    full = lambda line: bool(re.match(r"\d{1,2}/\d{1,2}/\d{4}", line))
    letter = lambda line: bool(re.search("[A-Za-z]", line))
    goes_on = lambda line, date: line != "" and not date and letter(line) and "$" not in line
    found, i, inside = [], 0, False
    while i < len(lines):
        here, after, third = at(i), at(i + 1), at(i + 2)
        if any_of(here, S.SECTION_START):
            inside = True
        elif inside and any_of(here, S.SECTION_END):
            inside = False
        elif not any_of(here, S.SUMMARIES + S.HEADERS) and (inside or re.match(r"\d{1,2}[/-]\d{1,2}", here)):
            found.append(i)
            if here == "":
                takes = 1
            elif dated(here):
                takes = 2 if goes_on(after, dated(after)) else 1
            elif not letter(here) or not full(after):
                takes = 1
            elif not re.search(r"[0-9,]*\d[0-9,]*\.\d{2}", re.sub(r"^\d{1,2}/\d{1,2}/\d{4}", "", after)):
                takes = 2
            else:
                takes = 3 if goes_on(third, full(third)) else 2
            i += takes - 1
        i += 1
    return found


@pytest.mark.parametrize("size", [1, 2, 3, 7, 512])
def test_chunks_agree_with_a_walk_over_all_lines(spark, size):
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])] + [(None, texts[0]), (1, None)], "doc_id long, text string").repartition(4)
    chunks = S._chunks(df, 2025, size)
    entered = chunks.join(S._entries(chunks), ["key", "chunk"], "left")
    got = entered.select("doc_id", "chunk", F.explode(S._heads(F.col("steps"), F.coalesce("entry", F.lit(0)))).alias("i")).collect()
    for i, t in enumerate(texts + texts[:3]):
        assert sorted(r["chunk"] * size + r["i"] for r in got if r["doc_id"] == i) == heads(t), t
    assert len([r for r in got if r["doc_id"] is None]) == len(heads(texts[0]))
    rows = [sorted((str(tuple(r)) for r in S.parse_statements(df, 2025, chunk=n).collect())) for n in (size, 512)]
    assert rows[0] == rows[1] and len(rows[0]) > 200


def test_a_long_statement_is_split_over_tasks(spark):
    lines = ["ACCOUNT ACTIVITY"] + [f"01/{i % 28 + 1:02}/2025 SHOP NUMBER{i % 7} ${i % 100}.25" for i in range(200_000)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    rows = S.parse_statements(df, 2025, clean=False)
    got = rows.agg(F.count("*"), F.sum("amount"), F.max("line_no")).first()
    assert got[0] == 200_000 and got[2] == 200_000 and float(got[1]) == sum(i % 100 + 0.25 for i in range(200_000))
