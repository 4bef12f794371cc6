"""What is known about merchants: names already cleaned, how frequent they are, which look alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_merchant, normalize_label
from ..session import stash
from ..sources.providers import TextProvider, ask, scrub_answer
from .ensemble import PromptSeries, names_by_series


def cache_key(name: Column) -> Column:
    return F.upper(F.trim(name))


def tier(freq: Column) -> Column:
    return F.when(freq >= 5, "high").when(freq >= 2, "medium").otherwise("low")


def merchant_frequency(history: DataFrame) -> DataFrame:
    """place, freq and tier of all places of three characters or more."""
    rows = history.where(F.length("place") >= 3).groupBy("place").agg(F.count("*").alias("freq"))
    return rows.withColumn("tier", tier(F.col("freq")))


def learn_names(history: DataFrame, order: str = "ordinal") -> DataFrame:
    """cache_key -> place: of the spellings of a key, the one that came up last for the first time."""
    first = history.where(F.length("place") >= 3).groupBy("place").agg(F.min(order).alias("seen"))
    return first.groupBy(cache_key(F.col("place")).alias("cache_key")).agg(F.max_by("place", F.struct("seen", "place")).alias("place"))


def merge_cache(cache: DataFrame, learned: DataFrame) -> DataFrame:
    """The cache with learned names in place of older ones."""
    return learned.select("cache_key", "place").unionByName(cache.join(learned, "cache_key", "left_anti").select("cache_key", "place"))


def used_names(ledger: DataFrame) -> DataFrame:
    """cache_key -> place of the names that a ledger was cleaned to, to be merged into the cache."""
    rows = ledger.where("place_original is not null and place is not null and trim(place) <> ''")
    return rows.groupBy(cache_key(F.col("place_original")).alias("cache_key")).agg(F.min("place").alias("place"))


def clean_names(ledger: DataFrame, cache: DataFrame | None = None, provider: TextProvider | PromptSeries | None = None, column: str = "place_original", holders: tuple[str, ...] = (), then: Callable[[Column], Column] | None = None) -> DataFrame:
    """The ledger with place: the cached name, else the provider's, else the pattern cleaner's.

    The different names are cleaned once each and joined back. The provider answers one question
    about each, or (a PromptSeries) a series of them that are voted on. then: a further step that each name goes through.
    """
    names = ledger.select(F.col(column).alias("raw_name")).where("raw_name is not null").distinct().withColumn("cache_key", cache_key(F.col("raw_name")))
    if cache is None:
        known = names.withColumn("cached", F.lit(None).cast("string"))
    else:
        known = names.join(cache.select("cache_key", F.col("place").alias("cached")), "cache_key", "left")
    fresh = known.where("cached is null").select("raw_name", clean_merchant(F.col("raw_name"), holders).alias("pattern"))
    if isinstance(provider, PromptSeries):
        fresh = stash(fresh, "patterns")
        won = names_by_series(fresh.select(F.col("pattern").alias("name")), provider).select(F.col("name").alias("pattern"), F.col("place").alias("won"))
        fresh = fresh.join(won, "pattern", "left").select("raw_name", F.coalesce(normalize_label(F.col("won")), "pattern").alias("place"))
    elif provider is None:
        fresh = fresh.withColumnRenamed("pattern", "place")
    else:
        answers = stash(fresh.withColumn("answer", ask(F.col("pattern"), provider)), "answers")  # each name is asked for once
        scrubbed = stash(answers.select("raw_name", "pattern", scrub_answer(F.col("answer"), F.col("raw_name")).alias("scrubbed")), "scrubbed")
        fresh = scrubbed.select("raw_name", F.coalesce(normalize_label(F.col("scrubbed")), "pattern").alias("place"))
    done = known.where("cached is not null").select("raw_name", F.col("cached").alias("place")).unionByName(fresh)
    if then is not None:
        done = done.withColumn("place", then(F.col("place")))
    done = stash(done, "names")  # the size of this table is known before the join, so few names don't shuffle the ledger
    return ledger.drop("place").join(done, ledger[column] == done["raw_name"], "left").drop("raw_name")


def similar_merchants(names: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """name, place, freq, rank: the k most frequent known places that hold a name or are held by it.

    Both are compared without spaces, "-" and "&", from three characters on. One side holds the
    other only if they share its first three characters somewhere, so they meet by triples of
    characters instead of all with all.
    """

    def bare(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), "[ &-]", "")

    def triples(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))

    a = names.select("name", bare(F.col("name")).alias("x")).distinct().where(F.length("x") >= 3)
    b = known.select("place", "freq", bare(F.col("place")).alias("y")).where(F.length("y") >= 3)
    inside = a.withColumn("t", F.explode(triples(F.col("x")))).join(b.withColumn("t", F.substring("y", 1, 3)), "t").where(F.contains("x", F.col("y")))
    around = a.withColumn("t", F.substring("x", 1, 3)).join(b.withColumn("t", F.explode(triples(F.col("y")))), "t").where(F.contains("y", F.col("x")))
    both = inside.select("name", "place", "freq").unionByName(around.select("name", "place", "freq")).distinct()
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("freq"), "place"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)
