"""Spelling variants against plain loops."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += len(word) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: (best if n[best] >= 10 * n[w] else None) if (best := min(near[w], key=lambda x: (-n[x], x), default=None)) else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def test_variants_against_plain_loops(spark, odd_documents):
    rng = random.Random(5)
    base = ["".join(rng.choice("abÀéñß") for _ in range(rng.randint(7, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "x" * 300]
    docs = []
    for i in range(700):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base[: 1 + int(len(base) * rng.random() ** 2)])
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "b", "É"]) + w[at + rng.randint(0, 1) :]
            words.append(w.upper() if w.isascii() and rng.random() < 0.2 else w)
        docs.append((i % 650, rng.choice([" ", "1", "…\n"]).join(words)))
    docs += [(None, " ".join(base)), (None, None), (3, ""), (4, "abcdefg" * 3000), (4, "abcdefg" * 3000), (5, "Ünïcödé Ünïcödé ŁŁŁŁŁŁŁŁ ŁŁŁŁŁŁŁŁ 你好你好你好你好 naïveté×÷ naïveté×÷")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = spelling.group_variants(spelling.stash(spelling.count_words(df), "words")).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs)
    assert sum(1 for r in got if r["form"]) > 20 and any(r["root"] != (r["form"] or r["word"]) for r in got)
    odd = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = spelling.group_variants(spelling.stash(spelling.count_words(odd_documents), "words")).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(odd)


def test_string_ids_and_no_documents(spark):
    docs = [("a", "letters letters"), ("b", "letters")]
    words = spelling.count_words(spark.createDataFrame(docs, "doc_id string, text string"))
    assert sorted(tuple(r)[:1] for r in spelling.group_variants(words).collect()) == [(r[0],) for r in plain(docs)]
    assert spelling.group_variants(words.limit(0)).count() == 0


def test_letter_sets_differ_by_two_bits_at_most():
    rng = np.random.default_rng(6)
    a = rng.choice(np.frombuffer("abyzàéÿ".encode("latin-1"), np.uint8), (500, 8))
    b = a.copy()
    b[np.arange(500), rng.integers(0, 8, 500)] = ord("q")
    assert max(int(x).bit_count() for x in (spelling._letter_sets(a) ^ spelling._letter_sets(b)).astype(np.uint64)) <= 2


def test_no_join_gathers_a_table_of_words(spark):
    words = spark.createDataFrame([("variants", 20), ("varients", 2), ("another", 3)], "word string, n long")
    for found in (spelling.near_words(words), spelling.group_variants(words)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
