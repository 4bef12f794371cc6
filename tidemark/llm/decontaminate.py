"""Benchmark decontamination: size-partitioned MinHash containment search.

A benchmark item is short and a document may be long, so that MinHash over whole documents
would find next to nothing. Items of at most 8 different shingles are looked up exactly, by
each of them, and so are items that repeat a shingle, for which the bounds below would not
hold. The others are divided by size: one with more than u / 2 and at most u shingle
positions belongs to the partition u (a power of two, 16 at least). For a
partition, documents are read in windows of 2 * u positions that start every u positions;
whatever run of u positions a document has, some window holds it whole. Inside a window an
item that is there in full has a Jaccard similarity of over 1/4, one that is there by three
quarters of about 1/6, and a signature of 48 minima misses these with a chance of about 1e-6
and 1e-4; runs lie in more than one window, which makes the chance smaller still.

A window's minimum can equal an item's only if the window holds the very shingle that has
the item's minimum. Windows without any such shingle are thus left out before their minima
are worked out, which changes no result. Every pair that shares a minimum is verified: the
item's different shingles that the whole document has, of all the item's shingles.

Shingles of items go to every task only as long as there are at most `most_sent` of them;
beyond that the same joins are done by shuffling.

Defined results: words are runs outside space and \\t to \\r, A-Z in lower case; a null or
empty text, and a document without an id, is never contaminated; an item or document of fewer
than k words has its whole sequence as one shingle; items with the same text each have their
own pairs; rows that repeat an id are searched each on its own, and the pair has the most that
one of them shares; no items or documents give no rows; further columns stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .url_rules import LOWER, UPPER

MINIMA, NARROWEST, MOST_EXACT = 48, 16, 8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), "")


def _shingle(k: int) -> Column:
    """The shingle that begins at `at`; columns words and at."""
    run = F.xxhash64(*[F.get("words", F.col("at") + j) for j in range(k)])
    return F.when(F.size("words") >= k, run).otherwise(F.xxhash64(F.array_join("words", " "), F.size("words")))


def _positions(k: int) -> Column:
    return F.greatest(F.size("words") - k, F.lit(0))


def _shingles(texts: DataFrame, k: int, *keep: str) -> DataFrame:
    """keep and shingle, for each position of texts (which have words)."""
    spread = texts.where(F.size("words") > 0).select(*keep, "words", F.explode(F.sequence(F.lit(0), _positions(k))).alias("at"))
    return spread.select(*keep, "at", _shingle(k).alias("shingle"))


def find_contamination(documents: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 75, most_sent: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, item_shingles, shared: the pairs where shared is at least percent of item_shingles."""
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("words"))
    width = F.greatest(F.lit(NARROWEST), F.pow(F.lit(2), F.ceil(F.log2(_positions(k) + 1))).cast("int"))
    # Width 0: looked up exactly.
    each = F.array_distinct(F.transform(F.sequence(F.lit(0), _positions(k)), lambda at: F.array_join(F.slice("words", at + 1, k), " ")))
    width = F.when((F.size(each) <= MOST_EXACT) | (F.size(each) <= _positions(k)), 0).otherwise(width)
    item_shingles = stash(_shingles(items.withColumn("width", width), k, "item_id", "width").drop("at").distinct(), "items")
    minima = stash(
        item_shingles.where("width > 0").withColumn("fn", F.explode(F.sequence(F.lit(0), F.lit(MINIMA - 1))))
        .withColumn("value", F.xxhash64("shingle", "fn")).groupBy("item_id", "width", "fn")
        .agg(F.min("value").alias("value"), F.min_by("shingle", "value").alias("shingle")),
        "item-minima",
    )

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= most_sent else df

    probes = minima.select("shingle", "width").unionByName(item_shingles.where("width = 0").select("shingle", "width")).distinct()
    hits = _shingles(texts.select("row", words(F.col("text")).alias("words")), k, "row").join(sent(probes), "shingle")
    window = F.explode(F.expr("if(width = 0, array(0), array(cast(at div width as int), cast(greatest(at div width - 1, 0) as int)))"))
    to_read = F.collect_set(F.when(F.col("width") > 0, F.struct("width", "window")))
    windows = stash(hits.select("row", "width", window.alias("window")).groupBy("row").agg(to_read.alias("windows")), "windows")
    found = stash(texts.join(windows, "row"), "window-texts").select("row", "doc_id", "windows", words(F.col("text")).alias("words"))

    spread = found.select("row", "words", F.explode("windows").alias("w")).select("row", "words", "w.width", "w.window")
    first = F.col("window") * F.col("width")
    inside = spread.select("row", "width", "window", "words", F.explode(F.sequence(first, F.least(first + 2 * F.col("width") - 1, _positions(k)))).alias("at"))
    own = (
        inside.select("row", "width", "window", _shingle(k).alias("shingle")).withColumn("fn", F.explode(F.sequence(F.lit(0), F.lit(MINIMA - 1))))
        .groupBy("row", "width", "window", "fn").agg(F.min(F.xxhash64("shingle", "fn")).alias("value"))
    )
    candidates = own.join(sent(minima.drop("shingle")), ["width", "fn", "value"]).select("row", "item_id").distinct()

    shared = (
        _shingles(found, k, "row", "doc_id").join(sent(item_shingles), "shingle").select("row", "doc_id", "item_id", "shingle").distinct()
        .groupBy("row", "doc_id", "item_id").agg(F.count("*").alias("shared"))
    )
    sizes = item_shingles.groupBy("item_id").agg(F.count("*").alias("item_shingles"), (F.min("width") == 0).alias("exact"))
    return (
        shared.join(candidates.withColumn("tried", F.lit(True)), ["row", "item_id"], "left").join(sent(sizes), "item_id").where("exact or tried")
        .where(F.col("shared") * 100 >= F.col("item_shingles") * percent).groupBy("doc_id", "item_id", "item_shingles").agg(F.max("shared").alias("shared"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), i as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark
), ds as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda p: array_to_string(w[p:p + 4], ' '))) as s from d where len(w) > 0
), js as (
  select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda p: array_to_string(w[p:p + 4], ' '))) as s from i where len(w) > 0
)
select doc_id, item_id, item_shingles, count(*) as shared
from ds join (select *, count(*) over (partition by item_id) as item_shingles from js) using (s)
group by doc_id, item_id, item_shingles having count(*) * 100 >= item_shingles * 75
"""
