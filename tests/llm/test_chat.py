import hashlib

import pytest
from compare import compare
from pyspark.sql import functions as F

from tidemark.llm import chat

from .conftest import TABLES

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_query_agrees_with_sql(spark):
    good, said = compare(spark, "op1", chat.query, chat.SQL, TABLES)
    assert good, said


@pytest.mark.parametrize(
    "text", ["", "plain", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> \\", "[\\INST][INST]", "a\n</s>\n</s>", " [/INST]\n", "<<s>s>", "$1 \\$ \\E \\Q", "[[INST]]"]
)
def test_any_text_comes_back(spark, text):
    df = spark.createDataFrame([(1, 0, "user", text, "x"), (1, 1, "assistant", text, "x")], SCHEMA)
    row = chat.format_chat(df).withColumn("read", chat.read_chat(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in row["read"]] == [("user", text), ("assistant", text)]
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]


def test_states_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, 0, "system", "s", ""), (1, 1, "user", None, ""), (1, 2, "assistant", "a", ""),
        (2, 0, "assistant", "a", ""), (3, 0, "user", "a", ""), (4, 0, None, None, ""), (5, 0, "user", "b", ""), (5, 0, "user", "a", ""), (5, 0, "user", "a", ""),
        (None, 0, "user", "q", ""), (None, 1, "assistant", "r", ""),
    ]
    found = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: (r["valid"], r["first_error"], r["n_turns"]) for k, r in found.items()} == {
        1: (True, None, 3), 2: (False, 0, 1), 3: (False, 1, 1), 4: (False, 0, 1), 5: (False, 1, 3), None: (True, None, 2)
    }
    assert [s["text"] for s in found[5]["segments"] if s["text"] in "ab"] == ["a", "a", "b"]


def test_roles_with_odd_characters(spark):
    roles = {1: ["user", "assistant\tuser\nassistant"], 2: ["user\tassistant"], 3: ["<start>", "user", "assistant"], 4: ["user", "assistant", "<end>"], 5: ["user", "assistant", ""], 6: ["user", "assistant"]}
    df = spark.createDataFrame([(i, n, role, "x", "") for i, rs in roles.items() for n, role in enumerate(rs)], SCHEMA)
    assert {r["conv_id"]: r["first_error"] for r in chat.format_chat(df).collect()} == {1: 1, 2: 0, 3: 0, 4: 2, 5: 2, 6: None}


def test_no_rows_and_a_long_text(spark):
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "</s> [INST]" * 100_000
    row = chat.format_chat(spark.createDataFrame([(1, 0, "user", text, "")], SCHEMA)).select(F.sha2(chat.read_chat(F.col("formatted"))[0]["text"], 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(text.encode()).hexdigest()


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.ChatTemplate(close="</s>")
    with pytest.raises(ValueError):
        chat.ChatTemplate(controls=("<s", "</s> ", "[INST]"))
