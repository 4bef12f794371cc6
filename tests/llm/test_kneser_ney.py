import math
from collections import Counter, defaultdict

import pytest

from tidemark.llm import kneser_ney

from .conftest import TABLES


def brute_model(texts: list[bytes], order: int):
    """Probability of a byte after a context, by the definition."""
    counts = {order: Counter(g for t in texts for g in ((b"\0" * (order - 1) + t)[i : i + order] for i in range(len(t))))}
    for size in range(order - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
    off, total, mass = {}, {}, {}
    for size, table in counts.items():
        n1, n2, n3, n4 = (sum(c == i for c in table.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [min(i, max(0, i - (i + 1) * y * b / a)) if a and n1 else i / 2 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off[size] = {g: d[min(c, 3) - 1] for g, c in table.items()}
        total[size], mass[size] = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[size][g[:-1]] += c
            mass[size][g[:-1]] += off[size][g]

    def p(gram: bytes) -> float:
        if not gram:
            return 1 / 256
        size, context = len(gram), gram[:-1]
        if context not in total[size]:
            return p(gram[1:])
        own = max(0, counts[size].get(gram, 0) - off[size].get(gram, 0)) / total[size][context]
        return own + mass[size][context] / total[size][context] * p(gram[1:])

    return p


def test_code_lengths_agree_with_brute_force(spark):
    training = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "mats and logs", "été là-bas"]
    texts = [(1, "the cat sat", "en"), (2, "zebra", "en"), (3, "", "en"), (4, None, None), (5, "été", "fr"), (6, "a dog sat on a mat, and the cat", "en")]
    tables = kneser_ney.train(spark.createDataFrame([(t,) for t in training], "text string"), 5)
    p = brute_model([t.encode() for t in training], 5)
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    for shard_rows in (4_000_000, 10):
        got = {r["doc_id"]: r for r in kneser_ney.score(df, tables, shard_rows).collect()}
        for i, text, _ in texts:
            raw = (text or "").encode()
            assert got[i]["n_bytes"] == len(raw)
            each = [-math.log2(p((b"\0" * 4 + raw)[j : j + 5])) for j in range(len(raw))]
            assert got[i]["bits"] == pytest.approx(sum(each), rel=1e-5)
            assert got[i]["excess"] == pytest.approx(sum(max(0, b - 8) for b in each), rel=1e-4, abs=1e-5)


def test_query_keeps_trusted_texts(spark):
    rows = kneser_ney.query(spark, TABLES).join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id", "left").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs)
    good = [r["kept"] for r in rows if r["trusted"]]
    assert sum(good) >= 0.95 * len(good)
    assert all(r["perplexity"] is None and not r["kept"] for r in rows if not docs[r["doc_id"]])


def test_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, None), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in kneser_ney.classify(odd_documents, labels).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7, 8, None} and not rows[2]["kept"] and not rows[3]["kept"]
    none = kneser_ney.classify(odd_documents, labels.limit(0)).collect()
    assert {r["doc_id"] for r in none if r["kept"]} == {1, 4, 5, 6, 7, 8, None}
    assert kneser_ney.classify(odd_documents.limit(0), labels).count() == 0


def test_rows_that_repeat_or_lack_an_id_have_their_own_scores(spark):
    docs = [(i, f"the plain words of trusted text number {i} go on", "en") for i in range(60)]
    docs += [(None, docs[7][1], "en"), (None, "zqx jjv 0x0x qqq", "en"), (3, "zqx jjv 0x0x qqq", "en"), (4, docs[4][1], "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60) if i != 3], "doc_id long, quality int, toxic int")
    rows = kneser_ney.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels).collect()
    assert sorted(r["kept"] for r in rows if r["doc_id"] is None) == [False, True]
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 3) == [False, True]
    assert len(rows) == 63 and sum(r["doc_id"] == 4 for r in rows) == 1


def test_shares_kept_of_toxic_bad_and_trusted_texts(spark):
    tables = "/root/testdata/sf0.01"
    rows = kneser_ney.query(spark, tables).join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id").collect()

    def share(quality: int, toxic: int) -> float:
        kept = [r["kept"] for r in rows if (r["quality"], r["toxic"]) == (quality, toxic)]
        return sum(kept) / len(kept)

    assert share(1, 0) >= 0.98 and share(1, 1) <= 0.3 and share(0, 0) <= 0.05


def test_a_few_strange_words_in_a_long_text(spark):
    words = "the plain words of trusted texts go on and on in other orders".split()
    docs = [(i, " ".join(words[(i * 5 + j * (1 + i % 3)) % len(words)] for j in range(400)), "en") for i in range(80)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    docs += [(100, docs[3][1][:900] + " qzxv jjkw " + docs[3][1][900:], "en"), (101, docs[3][1], "en")]
    rows = {r["doc_id"]: r for r in kneser_ney.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels).collect()}
    assert not rows[100]["kept"] and rows[100]["surprise"] > rows[100]["surprise_threshold"]
    assert rows[101]["kept"]
