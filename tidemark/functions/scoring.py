"""Scores of candidate names and descriptions, and votes over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import is_upper

# Words that scores count against a name.
BAD_WORDS = ["PURCHASE", "RECUR", "POS", "ACH", "WEB", "PMTS"]
VOTE_ARTIFACTS = ["PURCHASE", "RECUR", "POS", "WL*"]
LOCATIONS = [
    "fargo", "west", "east", "north", "south", "saint", "st ", "albany", "moorhead", "alexandria", "savage", "oakland",
    " nd", " mn", " ca", " wa", " va", " me", " sd", " ny",
]
DESCRIPTION_ARTIFACTS = ["PURCHASE", "RECUR", "WL*", "WL ", "SQ*", "TST*", "Payment.", "XX", "POS ", "ACH "]


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words. Places where none can begin, by the first characters of all words, are passed
    over without a look at each word."""
    heads = zip(*(w[:3] for w in words))
    classes = "".join(f"[{''.join(c if c.isalnum() else chr(92) + c for c in sorted(set(h)))}]" for h in heads)
    return text.rlike(f"(?={classes})(?:{'|'.join(f'{chr(92)}Q{w}{chr(92)}E' for w in words)})")


def _add(test: Column, yes: int, no: int = 0) -> Column:
    return F.when(test, yes).otherwise(no)


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def candidate_confidence(result: Column, original: Column, prompt: Column) -> Column:
    """0 to 100: how much a candidate looks like a cleaned name."""
    size, first = F.length(result), F.substring(result, 1, 1)
    total = (
        F.lit(50) + F.when(size.between(3, 30), 20).when(size > 30, -10).otherwise(0) + _add(is_upper(first), 10)
        + _add(F.lower(result) != F.lower(original), 15) + _add(F.contains(result, F.lit(" ")), 10)
        + _add(any_of(F.upper(result), BAD_WORDS), -20, 15) + _add(prompt == 2, 10)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def vote_score(result: Column, confidence: Column) -> Column:
    size, words = F.length(result), _words(result)
    return (
        confidence + _add(any_of(F.lower(result), LOCATIONS), -50) + _add(any_of(F.upper(result), VOTE_ARTIFACTS), -30)
        + F.when(size.between(5, 25), 15).when(size > 35, -10).otherwise(0) + F.when(words.between(2, 3), 10).when(words > 5, -10).otherwise(0)
    )


def weighted_vote(candidates: DataFrame, keys: list[str], result: str = "result", prompt: str = "prompt", confidence: str = "confidence") -> DataFrame:
    """For each key the winner: the first candidate if all agree, else the best score, the first on ties."""
    scored = candidates.withColumn("_score", vote_score(F.col(result), F.col(confidence)))
    return scored.groupBy(*keys).agg(
        F.when(F.count_distinct(F.lower(result)) == 1, F.min_by(result, prompt)).otherwise(F.max_by(result, F.struct(F.col("_score"), -F.col(prompt)))).alias("winner"),
        (F.count_distinct(F.lower(result)) == 1).alias("unanimous"),
    )


def description_score(place: Column, holders: tuple[str, ...] = ()) -> Column:
    """100 less what makes a description hard to read, such as the first names of account holders."""
    size, words, first = F.length(place), _words(place), F.substring(place, 1, 1)
    total = F.lit(100)
    for a in [*DESCRIPTION_ARTIFACTS, *(f"{x} " for x in holders)]:
        total = total + _add(F.contains(place, F.lit(a)) | F.contains(F.upper(place), F.lit(a)), -30)
    return (
        total + F.when(size > 40, -20).when(size > 25, -10).otherwise(0) + F.when(words > 5, -15).when(words > 4, -5).otherwise(0)
        + _add(is_upper(first), 5) + _add(first.rlike(r"^[\p{Ll}0-9]"), -10) + _add(first.isin("=", "-", ">", "<"), -20)
    )


def best_description(a: Column, b: Column, holders: tuple[str, ...] = ()) -> Column:
    return F.when(description_score(a, holders) >= description_score(b, holders), a).otherwise(b)
