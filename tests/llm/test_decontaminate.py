from compare import compare

from tidemark.llm import decontaminate

from .conftest import TABLES

ITEM = " ".join(f"item{i}" for i in range(40))


def test_query_agrees_with_sql(spark):
    good, said = compare(spark, "op3", decontaminate.query, decontaminate.SQL, TABLES)
    assert good, said


def test_containment_in_long_documents(spark):
    def around(part: str) -> str:
        return " ".join(f"x{i}" for i in range(3000)) + f" {part} " + " ".join(f"y{i}" for i in range(3000))

    words = ITEM.split()
    docs = [
        (1, around(ITEM.upper())), (2, around(" ".join(words[:32]))), (3, around(" ".join(words[:30]))), (4, around(" ".join(reversed(words)))),
        (5, around(" ".join([*words[:20], "new", *words[20:]]))), (6, None), (7, ""), (8, "a b c"), (None, ITEM), (9, ITEM), (9, ITEM), (10, "a b c d"),
    ]
    items = [(1, ITEM), (2, ITEM), (3, "a  B\tc"), (4, ""), (5, None), (None, ITEM), (6, " ".join(words[:5]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as shingle", "3 as width")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as words")
    for most in (1_000_000, 0):
        found = {(r["doc_id"], r["item_id"]): r["shared"] for r in decontaminate.find_contamination(d, i, most_sent=most).collect()}
        both = {(n, x): s for n, s in ((1, 36), (2, 28), (5, 32), (9, 36)) for x in (1, 2)}
        assert found == both | {(8, 3): 1} | {(n, 6): 1 for n in (1, 2, 3, 5, 9)}


def test_no_rows(spark):
    d, i = spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.find_contamination(d.limit(0), i).count() == 0
    assert decontaminate.find_contamination(d, i.limit(0)).count() == 0


def test_short_and_repetitive_items_in_long_documents(spark):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(1 + i % 12))) for i in range(240)]
    items += [(i, " ".join([f"i{i}again"] * (6 + i % 7))) for i in range(240, 300)]
    docs = [(i, text if len(text.split()) < 5 else " ".join([f"x{i}y{j}" for j in range(200)] + [text] + [f"z{i}y{j}" for j in range(200)])) for i, text in items]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(d, i).collect()}
    assert found == {(n, n) for n in range(300)}


def test_rows_that_repeat_an_id_with_other_texts(spark):
    item = [f"item{i}" for i in range(20)]
    docs = [(1, " ".join([f"x{i}" for i in range(2000)] + item + [f"y{i}" for i in range(2000)])), *((1, f"short row {i} of the same document") for i in range(60)), (2, " ".join(item[:10])), (2, " ".join(item[10:]))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find_contamination(d, i).collect()] == [(1, 7, 16, 16)]
