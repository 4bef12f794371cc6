"""Categories: the first keyword that fits, and the correction of labels that people type."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash
from ..sources.providers import TextProvider, ask_each, match_label

UNCATEGORIZED = "Uncategorized"


def category_of(description: Column, categories: dict[str, list[str]]) -> Column:
    """The first category, in order, of which a keyword is in the text; one chain of conditions, no join."""
    text, out = F.lower(description), None
    for name, keywords in categories.items():
        if keywords:
            test = text.rlike("|".join(f"\\Q{k.lower()}\\E" for k in keywords))
            out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return F.lit(UNCATEGORIZED) if out is None else out.otherwise(F.lit(UNCATEGORIZED))


def keyword_of(description: Column, categories: dict[str, list[str]]) -> Column:
    """The keyword that decided on the category, or null."""
    text, out = F.lower(description), None
    for words in categories.values():
        for k in words:
            test = F.contains(text, F.lit(k.lower()))
            out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("string") if out is None else out


def categorize(ledger: DataFrame, categories: dict[str, list[str]], column: str = "place") -> DataFrame:
    return ledger.withColumn("category", category_of(F.col(column), categories))


def categorize_by_table(ledger: DataFrame, keywords: DataFrame, column: str = "place", most_sent: int = 20_000, most_chars: int = 1_000_000) -> DataFrame:
    """As categorize(), with keywords (cat_order, category, kw_order, keyword) that are a table of any size.

    Up to most_sent keywords of most_chars characters in all go to the tasks, which find all of
    them in one pass over a text (an automaton), without a shuffle. A larger dictionary is joined:
    each keyword by its rarest gram, each different text by all of its grams. Both give the same.
    Categories of equal numbers go by name; keywords with a column that is null count for nothing,
    an empty keyword is in every text, and a text that is null has none.
    """
    order = F.struct("cat_order", "kw_order", "category")
    words = keywords.dropna(subset=["cat_order", "category", "kw_order", "keyword"]).groupBy(F.lower("keyword").alias("keyword")).agg(F.min(order).alias("found"))
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("keyword")), F.lit(0)).alias("chars")).first()
    rows = ledger.drop("category")
    if size["n"] <= most_sent and size["chars"] <= most_chars:
        ranked = sorted((tuple(r["found"]), r["keyword"]) for r in words.collect())
        match = _first_of([(keyword, found[2]) for found, keyword in ranked])
        return rows.withColumn("category", F.coalesce(match(F.lower(column)), F.lit(UNCATEGORIZED)))
    hits = _hits_by_gram(rows.select(F.col(column).alias("name")).where("name is not null").distinct(), words)
    return rows.join(hits, rows[column] == hits["name"], "left").drop("name").withColumn("category", F.coalesce("category", F.lit(UNCATEGORIZED)))


def _first_of(words: list[tuple[str, str]]):
    """A function of texts: the category of the first of these keywords (keyword, category) that is in each."""

    @F.pandas_udf("string")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = ahocorasick.Automaton()
        for rank, (keyword, _) in enumerate(words):
            if keyword:
                found.add_word(keyword, rank)
        found.make_automaton()
        always = next((rank for rank, (keyword, _) in enumerate(words) if not keyword), len(words))

        def first(text: str) -> str | None:
            rank = min((rank for _, rank in found.iter(text)), default=always) if len(found) else always
            rank = min(rank, always)
            return words[rank][1] if rank < len(words) else None

        for batch in batches:
            yield batch.map({text: first(text) for text in batch.dropna().unique()}).astype(object)

    return match


def _hits_by_gram(names: DataFrame, words: DataFrame, gram: int = 4) -> DataFrame:
    """name and category of the different names that have one of the words (keyword, found).

    A word is looked up by one key: itself if it has at most `gram` characters, else the one of its
    grams that the fewest words have. A text that has the word has that key among its substrings
    of the same length.
    """
    words = stash(words, "keywords")
    short, long = words.where(F.length("keyword") <= gram), words.where(F.length("keyword") > gram)

    def parts(text: Column, size: Column | int) -> Column:
        many = F.length(text) - size + 1
        return F.when(many > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(text, i, size))))

    grams = long.select("keyword", "found", F.explode(parts(F.col("keyword"), F.lit(gram))).alias("key"))
    often = grams.groupBy("key").agg(F.count("*").alias("n"))
    rare = grams.join(often, "key").groupBy("keyword").agg(F.min(F.struct("n", "key")).alias("rare"), F.first("found").alias("found"))
    keyed = short.select("keyword", "found", F.col("keyword").alias("key")).unionByName(rare.select("keyword", "found", F.col("rare.key").alias("key")))
    sizes = [r[0] for r in words.select(F.least(F.length("keyword"), F.lit(gram))).distinct().collect()]  # numbers from 0 to gram
    texts = names.withColumn("lower", F.lower("name"))
    keys = F.flatten(F.array(*[F.coalesce(parts(F.col("lower"), F.lit(n)), F.array().cast("array<string>")) if n else F.array(F.lit("")) for n in sizes]))
    pairs = texts.select("name", "lower", F.explode(keys).alias("key")).join(keyed, "key").where(F.contains("lower", "keyword"))
    return pairs.groupBy("name").agg(F.min("found")["category"].alias("category"))


def ask_categories(ledger: DataFrame, categories: dict[str, list[str]], provider: TextProvider | None, column: str = "place") -> DataFrame:
    """The ledger, with a provider's categories for rows that no keyword fits. Answers that name no category count for nothing."""
    if provider is None or not categories:
        return ledger
    value = F.coalesce(F.concat(F.lit(" for $"), F.col("amount").cast("decimal(12,2)").cast("string")), F.lit(""))
    prompt = F.concat(F.lit(f"Which one of these categories fits a payment best: {', '.join(categories)}? Answer with its name only, or {UNCATEGORIZED}.\nPayment to: "), F.col(column), value)
    asked = ask_each(ledger, F.when(F.col("category") == UNCATEGORIZED, prompt), provider, "_answer")
    return asked.withColumn("category", F.coalesce(match_label(F.col("_answer"), list(categories), exact=True), "category")).drop("_answer")


def correct_categories(labels: DataFrame, valid: list[str], cutoff: float = 0.7, provider: TextProvider | None = None) -> DataFrame:
    """label -> label, category, is_valid for the different labels.

    Blank is Uncategorized; then equality in any case; then a provider's answer, if it names a
    valid category; then the closest name by difflib's ratio, if it reaches the cutoff; else the
    label stays and isn't valid. Only labels that fail the exact test reach Python.
    """
    exact = {v.lower(): v for v in [*valid, UNCATEGORIZED]}
    lookup = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])
    lower = {v.lower(): v for v in valid}

    @F.pandas_udf("string")
    def closest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            best = (difflib.get_close_matches(x.lower(), list(lower), n=1, cutoff=cutoff) for x in batch)
            yield pd.Series([lower[b[0]] if b else None for b in best], index=batch.index, dtype=object)

    each = labels.select("label").distinct().withColumn("trimmed", F.trim(F.coalesce("label", F.lit(""))))
    each = each.withColumn("known", F.when(F.col("trimmed") == "", F.lit(UNCATEGORIZED)).otherwise(F.try_element_at(lookup, F.lower("trimmed"))))
    sure = each.where("known is not null").select("label", F.col("known").alias("category"), F.lit(True).alias("is_valid"))
    names = "\n".join(valid)
    prompt = F.concat(F.lit("Somebody typed this as a category: "), F.col("trimmed"), F.lit(f"\nWhich of these is meant? Answer with its name only.\n{names}"))
    rest = ask_each(each.where("known is null"), prompt, provider, "answer")
    rest = rest.withColumn("near", F.coalesce(match_label(F.col("answer"), valid), closest("trimmed")))
    return sure.unionByName(rest.select("label", F.coalesce("near", "label").alias("category"), F.col("near").isNotNull().alias("is_valid")))
