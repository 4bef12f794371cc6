import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.llm import quality_rules

from .conftest import TABLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_query_counts_agree_with_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    rows = quality_rules.query(spark, TABLES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_rejects_labelled_junk_and_keeps_the_rest(spark):
    larger = TABLES.replace("0.001", "0.01")  # enough labels of both kinds
    kept = quality_rules.query(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").toPandas()
    good, bad = kept[kept.quality == 1], kept[kept.quality == 0]
    print(pd.crosstab(kept.quality, [kept.base_failed, kept.rule.fillna(0)]))
    assert good.kept.mean() > 0.95 and bad.kept.mean() < 0.5


def test_odd_rows(spark, odd_documents):
    rows = quality_rules.judge_quality(odd_documents, []).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows))) == sorted(str((i, *brute(t))) for i, t in texts)
    kept = quality_rules.keep_good(odd_documents, [])
    assert kept.columns == odd_documents.columns and kept.exceptAll(odd_documents).isEmpty()
    assert quality_rules.keep_good(odd_documents.limit(0), []).count() == 0


def test_lines_and_windows(spark):
    texts = ["a\nb\na\n\n\na", "x" * 5, "\n", "a b c d e a b c d e", "a b c d e f a b c d e", "ü ü ü ü ü ü\nü", "w " * 5000]
    rows = quality_rules.text_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])


def test_learning():
    rng = np.random.default_rng(1)
    x = pd.DataFrame({"u": rng.random(600), "v": rng.random(600)})
    bad = ((x.u > 0.8) | ((x.v < 0.2) & (x.u < 0.5))).to_numpy()
    rules = quality_rules.learn_decision_list(x, bad)
    hit = np.zeros(600, bool)
    for rule in rules:
        hit |= quality_rules._covers(rule, x)
    assert hit[bad].mean() > 0.9 and hit[~bad].mean() < 0.05
    assert quality_rules.learn_decision_list(x, rng.random(600) < 0.5) == []


def test_labels_that_teach_nothing(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.learn_from_labels(odd_documents, labels) == []


def test_ids_that_repeat_and_odd_names(spark):
    """One id has most of the rows: the sample stays within its bound, and equal rows teach once."""
    words = [f"w{i}" for i in range(40)]
    text = F.array_join(F.slice(F.array(*map(F.lit, words)), 1, (F.col("id") % 25 + 12).cast("int")), " ")
    junk = F.when(F.col("id") % 2 == 0, F.concat(text, F.lit(" ###### $$$$ %%%%"))).otherwise(text)
    docs = spark.range(3000).select(F.when(F.col("id") < 600, F.col("id")).otherwise(F.lit(0)).alias("doc_id"), junk.alias("text"), F.lit(1).alias("a name-with.marks"))
    labels = spark.range(600).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    seen = []
    learn = quality_rules.learn_decision_list
    for most in (20_000, 100):
        quality_rules.learn_decision_list = lambda x, bad: seen.append(len(x)) or learn(x, bad)
        try:
            rules = quality_rules.learn_from_labels(docs, labels, most)
        finally:
            quality_rules.learn_decision_list = learn
    assert 600 <= seen[0] <= 650 and seen[1] <= 100
    kept = quality_rules.keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty()
