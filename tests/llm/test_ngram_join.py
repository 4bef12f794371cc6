import random
import re

from tidemark.llm import ngram_join
from tidemark.llm.components import connected_components

from .conftest import COLUMNS, TABLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> set:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows: list[tuple]) -> dict:
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df) -> dict:
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_agrees_with_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    assert found(ngram_join.query(spark, TABLES)) == brute(rows)


def test_groups_of_near_copies_chains_and_odd_texts(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(80)] = f"z{rng.randrange(9)}"
        rows.append(" ".join(copy))
    chain = list(base[:60])
    for i in range(40):  # each like the one before, the ends unlike each other
        chain = [*chain[2:], f"c{i}", f"d{i}"]
        rows.append(" ".join(chain))
    rows += ["one two", "ONE  two", "one two three", "", None, " \n", "a b c d e", "A b c d\te", "b " * 30_000, "b " * 20_000]
    numbered = list(enumerate(rows, 1))
    rng.shuffle(numbered)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in numbered], COLUMNS).selectExpr("*", "1 as node", "2 as n", "3 as label")
    assert found(ngram_join.similar_components(df)) == brute(numbered)


def test_long_lists_in_blocks_and_joins_without_broadcast(spark, monkeypatch):
    """The same groups when every list of more than ten postings is a long one, and when sets are joined by shuffles."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(70)]
    rows = []
    for i in range(1, 120):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(70)] = f"z{rng.randrange(30)}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(f"u{i}v{j}" for j in range(20))) for i in range(20)]
    for name, value in (("BLOCK", 10), ("SHORT", 5), ("MOST_SENT", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    assert found(ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "some other text of its own here"), (3, "some other text of its own here")]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (2, 2), (3, 2)]


def test_odd_rows(spark, odd_documents):
    rows = ngram_join.similar_components(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1), (None, None), (7, 7), (8, 8)}
    assert ngram_join.similar_components(odd_documents.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(5, 5)]
    root = {i: i for p in links for i in p}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root[i] for i in {i for p in links if p[0] != p[1] for i in p}}


def test_string_ids(spark):
    rows = [(f"d{i:02}", " ".join(f"w{i // 3}x{j}" for j in range(40)) + (f" own{i}" if i % 3 else "")) for i in range(12)] + [("short", "one two"), ("e", ""), (None, "one two")]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]} == {f"d{i:02}": f"d{i // 3 * 3:02}" for i in range(12)} | {"short": "short", "e": "e"}
