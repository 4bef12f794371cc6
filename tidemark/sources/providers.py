"""Hooks for what lives outside the engine: text from images and PDFs, answers of language models.

A provider is a Python object with one method over a pandas Series; operators call it in Arrow
batches on the executors. Without one, the null provider answers nothing and every operator
goes on with its own rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..session import stash


class TextProvider(Protocol):
    def answer(self, inputs: pd.Series) -> pd.Series:
        """A text, or None, for each input."""


class NullProvider:
    def answer(self, inputs: pd.Series) -> pd.Series:
        return pd.Series([None] * len(inputs), index=inputs.index, dtype=object)


def ask(column: Column, provider: TextProvider | None = None) -> Column:
    """The provider's answers; null without a provider, and then no Python runs."""
    if provider is None or isinstance(provider, NullProvider):
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield provider.answer(batch)

    return answers(column)


def extract_text(statements: DataFrame, digital: TextProvider | None = None, optical: TextProvider | None = None) -> DataFrame:
    """statements (doc_id, content) -> doc_id, extractor (A: digital, B: optical), text; a failure is an empty text."""
    sides = [("A", digital), ("B", optical)]
    both = [statements.select("doc_id", F.lit(name).alias("extractor"), F.coalesce(ask(F.col("content"), p), F.lit("")).alias("text")) for name, p in sides]
    return both[0].unionByName(both[1])


WORD_BOXES = "array<struct<text:string,x:int,y:int,width:int,height:int,confidence:double>>"


def clean_boxes(boxes: Column) -> Column:
    """Recognised words without blank ones."""
    return F.filter(boxes, lambda w: F.trim(w["text"]) != "")


def in_reading_order(boxes: Column) -> Column:
    """The text of words as they are read: lines from top to bottom, each from left to right.

    Words are taken by the height of their middles. A word belongs to the line above it if it
    overlaps the first word of that line by half of the lower one of the two; else it starts a
    line. Blank words are left out; no words give an empty text.
    """

    def entry(w: Column) -> Column:
        return F.struct((2 * w["y"] + w["height"]).alias("middle"), w["x"].alias("x"), F.trim(w["text"]).alias("text"), w["y"].alias("top"), (w["y"] + w["height"]).alias("bottom"))

    def word(w: Column) -> Column:
        return F.array(F.struct(w["x"].alias("x"), w["middle"].alias("middle"), w["text"].alias("text")))

    def closed(state: Column) -> Column:
        line = F.array_join(F.transform(F.array_sort(state["line"]), lambda w: w["text"]), " ")
        return F.when(F.size(state["line"]) > 0, F.concat(state["lines"], F.array(line))).otherwise(state["lines"])

    def add(state: Column, w: Column) -> Column:
        both = F.least(state["bottom"], w["bottom"]) - F.greatest(state["top"], w["top"])
        same = (both > 0) & (2 * both >= F.least(state["bottom"] - state["top"], w["bottom"] - w["top"]))
        longer = F.struct(state["lines"].alias("lines"), F.concat(state["line"], word(w)).alias("line"), state["top"].alias("top"), state["bottom"].alias("bottom"))
        return F.when(same, longer).otherwise(F.struct(closed(state).alias("lines"), word(w).alias("line"), w["top"].alias("top"), w["bottom"].alias("bottom")))

    none = F.lit(0).cast("int")
    start = F.struct(
        F.array().cast("array<string>").alias("lines"), F.array().cast("array<struct<x:int,middle:int,text:string>>").alias("line"), none.alias("top"), none.alias("bottom")
    )
    return F.aggregate(F.array_sort(F.transform(clean_boxes(boxes), entry)), start, add, lambda s: F.array_join(closed(s), "\n"))


def region_text(
    boxes: Column, left: Column, top: Column, right: Column, bottom: Column, page_width: Column, page_height: Column, padding: int = 0, share: float = 0.5
) -> Column:
    """The text of a region of a page, in reading order.

    The region is shrunk by a padding on each side, then cut to the page. Words count if at least
    `share` of their area is inside. A region that has no area, or has an edge that is null, has
    an empty text; so has a page without words.
    """
    edges = [left + padding, top + padding, right - padding, bottom - padding]
    x0, y0, x1, y1 = F.greatest(edges[0], F.lit(0)), F.greatest(edges[1], F.lit(0)), F.least(edges[2], page_width), F.least(edges[3], page_height)

    def inside(w: Column) -> Column:
        across = F.least(w["x"] + w["width"], x1) - F.greatest(w["x"], x0)
        down = F.least(w["y"] + w["height"], y1) - F.greatest(w["y"], y0)
        return (across > 0) & (down > 0) & (across.cast("double") * down >= share * w["width"] * w["height"])

    real = (x1 > x0) & (y1 > y0)
    for e in edges:
        real &= e.isNotNull()
    return F.coalesce(F.when(real, in_reading_order(F.filter(boxes, inside))), F.lit(""))


def cell_text(boxes: Column, left: Column, top: Column, right: Column, bottom: Column, page_width: Column, page_height: Column, padding: int = 2) -> Column:
    """The text of a table's cell: its region without the borders."""
    return region_text(boxes, left, top, right, bottom, page_width, page_height, padding)


# What marks the end of a model's answer, and what may stand before it.
ANSWER_MARKERS = [" Merchant:", " Business:", " Name:", " Clean name:", " Input:", " Transaction:", " Examples:", " REMOVE"]
ANSWER_PREFIXES = ["SQ*", "SQ *", "TST*", "TST *", "WL*", "WL *", "YSI*", "YSI *", "XX", "POS "]
PROMPT_PREFIXES = [
    "Output:", "Answer:", "Result:", "Clean name:", "Business:", "Business name:", "Name:", "The business name is:", "Merchant:", "Extract:", "Transaction:",
    "Critical rules:", "Critical Rules Applied:", "Rules for extraction:", "Examples:", "You are", "Based on", "Simplify:", "Input:", "REMOVE ALL:", "KEEP:",
    "MUST REMOVE:", "STANDARDIZE:",
]
ECHOES = [
    "transaction text", "extract the", "business name", "one line", "merchant name", "simplify this", "remove:", "fix:", "remove all", "must remove", "keep:",
    "standardize:",
]
CHAIN_WORDS = ["Home", "Depot", "Cash", "App", "Grand", "Junction", "Coborns", "Coborn", "Wine", "More"]


def scrub_answer(answer: Column, original: Column) -> Column:
    """A model's answer as a name, or null if it is an echo, the input itself or no name."""

    def before_marker(t: Column) -> Column:
        out = F.when(F.contains(t, F.lit(ANSWER_MARKERS[0])), F.substring_index(t, ANSWER_MARKERS[0], 1))
        for marker in ANSWER_MARKERS[1:]:
            out = out.when(F.contains(t, F.lit(marker)), F.substring_index(t, marker, 1))
        return F.trim(out.otherwise(t))

    def before_chain(t: Column) -> Column:
        words = F.split(t, r"\s+")
        at = F.array_min(F.transform(words, lambda w, i: F.when((i > 2) & w.isin(CHAIN_WORDS), i)))
        cut = F.array_join(F.slice(words, F.lit(1), F.coalesce(at, F.lit(0))), " ")
        return F.when((F.size(words) > 4) & at.isNotNull(), cut).otherwise(t)

    def checked(t: Column) -> Column:
        echo = F.lower(t).rlike("|".join(ECHOES))
        return F.when(~echo & F.length(t).between(3, 60) & t.rlike(r"\pL") & (F.lower(t) != F.lower(original)), t)

    t = F.trim(F.substring_index(F.trim(F.regexp_replace(answer, "[\"']", "")), "\n", 1))
    t = let(t, before_marker)
    for p in ANSWER_PREFIXES:
        t = F.regexp_replace(t, rf"(?i)^\Q{p}\E\s*", "")
    t = F.replace(F.replace(t, F.lit("* "), F.lit(" ")), F.lit(" *"), F.lit(" "))
    t = let(F.trim(F.regexp_replace(t, r"^\*+|\*+$", "")), before_chain)
    for p in PROMPT_PREFIXES:
        t = F.regexp_replace(t, rf"(?i)^\Q{p}\E\s*:*\s*", "")
    return let(F.trim(t), checked)


def ask_each(rows: DataFrame, prompt: Column, provider: TextProvider | None, name: str) -> DataFrame:
    """The rows with the answer to their prompt in column `name`; those whose prompt is null aren't asked about.

    Each different prompt is asked once, and the answers are written before they are used.
    """
    if provider is None or isinstance(provider, NullProvider):
        return rows.withColumn(name, F.lit(None).cast("string"))
    asking = rows.withColumn("_prompt", prompt)
    asked = asking.select("_prompt").where("_prompt is not null").distinct()
    answers = stash(asked.select("_prompt", ask(F.col("_prompt"), provider).alias(name)), "answers")
    others = asking.where("_prompt is null").withColumn(name, F.lit(None).cast("string"))
    return asking.where("_prompt is not null").join(answers, "_prompt", "left").unionByName(others).drop("_prompt")


def match_label(answer: Column, labels: list[str], exact: bool = False) -> Column:
    """The label that an answer names, in any case, or null.

    An equal one goes before one in another case; unless exact, punctuation at the end is left out.
    """
    bare = F.trim(answer if exact else F.regexp_replace(F.trim(answer), "[.,;:!?]+$", ""))
    out = F.lit(None).cast("string")
    for label in reversed(labels):
        out = F.when(F.lower(bare) == label.lower(), F.lit(label)).otherwise(out)
    return F.when(bare.isin(labels), bare).otherwise(out) if labels else out


def income_or_expense(answer: Column) -> Column:
    """"income" if the answer has that word, else "expense"."""
    return F.when(F.contains(F.lower(answer), F.lit("income")), F.lit("income")).otherwise(F.lit("expense"))
