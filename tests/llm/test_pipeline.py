from collections import Counter

import pytest

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngram_join, quality_rules
from tidemark.session import shared_dir

from .conftest import TABLES
from .test_line_dedup import distance
from .test_ngram_join import brute, shingles

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_the_table(spark):
    documents = spark.read.parquet(f"{TABLES}/documents.parquet")
    docs, sizes = documents, [documents.count()]
    for name, stage in pipeline.STAGES:
        before, docs = docs, pipeline.stash(stage(spark, docs, TABLES), "test")
        sizes.append(docs.count())
        if name != "mixing sources":
            assert docs.columns == documents.columns
        if name == "n-gram Jaccard join":
            groups = ngram_join.similar_components(before).where("component_id is not null").select("component_id").distinct().count()
            assert docs.count() == groups
        if name == "benchmark decontamination":
            assert decontaminate.find_contamination(docs, spark.read.parquet(f"{TABLES}/benchmark.parquet")).count() == 0
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] >= sizes[4] == sizes[5] > 0.5 * sizes[0]
    assert {r[0] for r in docs.select("mix_position").collect()} == set(range(sizes[5]))


def lines_that_stay(rows: list[tuple]) -> dict:
    """Text by id after line dedup, by comparing every line of 20 characters or more with every other."""
    firsts: dict[str, tuple] = {}
    compared = lambda x: x and (len(x) >= 20 or x.strip())
    for i, text in sorted(rows):
        for at, line in enumerate(text.split("\n")):
            if compared(line):
                firsts.setdefault(line, (i, at))
    long = [(line, place, Counter(line)) for line, place in firsts.items() if len(line) >= 20]
    near = set()
    for a, place, bag in long:
        for b, before, other in long:
            if before < place and abs(len(a) - len(b)) <= 2 and (bag - other).total() <= 2 and (other - bag).total() <= 2 and distance(a, b) <= 2:
                near.add(a)
    return {i: "\n".join(x for at, x in enumerate(t.split("\n")) if not compared(x) or (firsts[x] == (i, at) and x not in near)) for i, t in rows}


def test_stages_agree_with_brute_force(spark):
    """Each stage on what the one before it kept, over a whole table."""
    documents, benchmark = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "benchmark"))
    stages = dict(pipeline.STAGES)

    def run(name: str, docs):
        out = pipeline.stash(stages[name](spark, docs, TABLES), "test")
        return out, {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}

    docs, texts = run("quality rules", documents)
    assert set(texts) == {r["doc_id"] for r in quality_rules.query(spark, TABLES).collect() if r["kept"]}
    expected = {i: t for i, t in lines_that_stay(list(texts.items())).items() if t.strip() or t == texts[i]}
    docs, texts = run("line dedup", docs)
    assert texts == expected
    groups = brute(list(texts.items()))
    docs, after = run("n-gram Jaccard join", docs)
    assert after == {i: t for i, t in texts.items() if groups[i][1] == i}
    items = [x for r in benchmark.collect() if (x := shingles(r["text"]))]
    docs, clean = run("benchmark decontamination", docs)
    assert clean == {i: t for i, t in after.items() if not any(100 * len(x & shingles(t)) >= 75 * len(x) for x in items)}
    docs, mixed = run("mixing sources", docs)
    assert mixed == clean and sorted(r[0] for r in docs.select("mix_position").collect()) == list(range(len(clean)))


def test_odd_rows(spark, odd_documents):
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd_documents, TABLES)
        assert out.columns[: len(odd_documents.columns) - 1] == odd_documents.columns[:-1], name
        left = sorted((str(r["doc_id"]), len(r["text"] or "")) for r in out.collect())
        whole = sorted((str(r["doc_id"]), len(r["text"] or "")) for r in odd_documents.collect())
        if name == "line dedup":  # both lines of document 6 are in document 1
            assert left == [x for x in whole if x[0] != "6"]
        elif name == "n-gram Jaccard join":  # 1, the two rows of 6 and one without an id have the same text
            assert Counter(left) == Counter(whole) - Counter([x for x in whole if x[0] == "6"] + [("None", len(odd_documents.where("doc_id = 1").first()["text"]))])
        elif name != "quality rules":
            assert left == whole


def test_one_row_of_each_near_duplicate_group(spark):
    def words(name: str, n: int = 40) -> str:
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [
        (None, words("alone"), "a"), (None, words("twin"), "b"), (None, words("twin") + " more", "c"), (3, words("third"), "d"), (None, words("third"), "e"),
        (4, words("same"), "f"), (4, words("same"), "f"), (5, words("first"), "g"), (6, words("first"), "h"), (6, words("sixth"), "i"), (7, words("sixth"), "j"),
        (None, None, "k"), (None, "", "l"), (8, "", "m"), (9, None, "n"),
    ]
    out = pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), TABLES)
    got = sorted(r["source"] for r in out.collect())
    assert [x for x in got if x not in "bc"] == list("adfgiklmn") and len(got) == 10, got


def test_contaminated_rows_go_by_row(spark):
    item = " ".join(f"bench{i}" for i in range(30))
    clean = " ".join(f"clean{i}" for i in range(50))
    rows = [(1, clean, "a"), (1, f"before {item} after", "b"), (None, f"x {item}", "c"), (None, clean, "d"), (2, clean, "e"), (2, clean, "e"), (3, None, "f"), (4, item, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"odd name-1": F.lit(1), "tags": F.create_map(F.lit("k"), F.col("source")), "row_hash": F.lit("x")})
    root = f"{shared_dir(spark)}/bench-tables"
    spark.createDataFrame([(9, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{root}/benchmark.parquet")
    out = pipeline.decontamination_stage(spark, docs, root)
    assert out.columns == docs.columns and sorted(r["source"] for r in out.collect()) == list("adeef")
    once = sorted(r["source"] for r in pipeline.near_duplicate_stage(spark, docs, root).collect())
    assert once[0] == "a" and "f" in once and not {"d", "e"} & set(once)
    mixed = pipeline.mixing_stage(spark, docs, root)
    assert sorted(r["mix_position"] for r in mixed.collect()) == list(range(len(rows)))
