import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import language_id

from .conftest import TABLES

SCHEMA = "doc_id long, text string, lang string"


def brute_bits(training: list[bytes], text: bytes) -> float:
    """Code length of text, byte by byte, by the definition."""
    counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for t in training:
        for i in range(len(t)):
            c = (b"\0\0\0" + t)[i : i + 4]
            for order in range(4):
                counts[c[3 - order : 3]][c[3]] += 1
    total = 0.0
    for i in range(len(text)):
        c = (b"\0\0\0" + text)[i : i + 4]
        for order in (3, 2, 1, 0, -1):
            if order < 0:
                total += 8
                break
            seen = counts.get(c[3 - order : 3])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if c[3] in seen:
                total -= math.log2(seen[c[3]] / (n + d))
                break
            total -= math.log2(d / (n + d))
    return total


def test_held_out_accuracy(spark):
    found = language_id.query(spark, TABLES).join(spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["lang"] and r["lang_pred"] != "und" and len(r["text"].split()) >= 10]
    assert len(held) > 10 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_code_lengths_are_exact(spark):
    training = [(1, "the cat sat on the mat", "en"), (2, "then the dog came", "en"), (3, "le chat est là", "fr"), (4, "été à la mer", "fr")]
    texts = [(10, "the mat"), (11, "la mer été"), (12, "zzz 你好"), (13, "e")]
    trees = language_id.load_trees(language_id.count_contexts(spark.createDataFrame(training, SCHEMA)))
    scores = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(texts, "doc_id long, text string"), trees).collect()}
    for doc_id, text in texts:
        bits = {x: brute_bits([t.encode() for _, t, y in training if y == x], text.encode()) for x in ("en", "fr")}
        best = min(bits, key=bits.get)
        assert scores[doc_id]["lang_pred"] == best
        assert scores[doc_id]["score"] == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel=1e-4)


def test_all_leaves_stay_and_shards_agree(spark):
    """More than 500,000 bytes a language, by brute force, with one shard and with many."""
    rng = random.Random(1)
    training = [(i, "".join(rng.choice(letters) for _ in range(26_000)), lang) for i in range(20) for lang, letters in (("x", "abcdefgh é"), ("y", "abcdefgh ñ"))]
    df = spark.createDataFrame(training, SCHEMA)
    contexts = language_id.stash(language_id.count_contexts(df), "test-contexts")
    grams = {lang: {(b"\0\0\0" + t.encode())[i : i + 4] for _, t, x in training if x == lang for i in range(len(t.encode()))} for lang in "xy"}
    assert {r["lang"]: r["count"] for r in contexts.where("size = 4").groupBy("lang").count().collect()} == {x: len(g) for x, g in grams.items()}
    texts = [(10, "abc defgh é" * 5), (11, "hgf eñed cba" * 4), (12, "a"), (13, "zzz 你好 é"), (14, None), (15, "hhhh"), (15, "hhhh")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one, many = (sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs, language_id.load_trees(contexts, most)).collect()) for most in (2_000_000, 3_000))
    assert len(list(language_id.load_trees(contexts, 3_000))) > 3 and one == many
    for doc_id, lang, score in one:
        text = dict(texts)[doc_id]
        if text is not None:
            bits = {x: brute_bits([t.encode() for _, t, y in training if y == x], text.encode()) for x in "xy"} if doc_id in (10, 12, 13) else None
            assert bits is None or (lang == min(bits, key=bits.get) and score == pytest.approx(1 / sum(2 ** (min(bits.values()) - b) for b in bits.values()), rel=1e-3))


def test_two_hundred_languages(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 40, f"l{i:03}") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    shards = list(language_id.load_trees(language_id.count_contexts(df), 1_000))
    assert len(shards) > 1 and all(len(x.langs) == 200 for x in shards)
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, shards).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) >= 195


def test_the_hash_table_grows(spark):
    (trees,) = language_id.load_trees(language_id.count_contexts(spark.createDataFrame([(1, "".join(map(chr, range(32, 1500))), "a")], SCHEMA)))
    assert not trees._hashed(10) and trees._hashed(14)
    assert (trees.find(trees.keys) == np.arange(len(trees.keys))).all()


def test_odd_rows(spark, odd_documents):
    trees = language_id.load_trees(language_id.count_contexts(odd_documents))
    rows = language_id.identify(odd_documents, trees).collect()
    assert len(rows) == odd_documents.count()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 4, None}
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], SCHEMA)
    assert list(language_id.load_trees(language_id.count_contexts(docs))) == []
    assert language_id.identify(docs, []).first()["lang_pred"] == "und"
    assert language_id.identify(docs.limit(0), []).count() == 0
