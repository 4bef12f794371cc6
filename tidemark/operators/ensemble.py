"""Names from a series of prompts: several questions about each name, to several models, and a vote over the answers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import candidate_confidence, weighted_vote
from ..session import stash
from ..sources import sinks
from ..sources.providers import scrub_answer

ANSWERS = "name string, prompt int, model string, answer string"
PROMPTS = (
    "Which business does this line of a bank statement name? Leave out codes, numbers and words about the payment.\nInput: {name}\nOutput:",
    "Give this business name without towns, states, directions and numbers of shops.\nInput: {name}\nOutput:",
    "Is this the name of a business? If it isn't, give the right name.\nTransaction: {name}\nValid:",
)


class ModelProvider(Protocol):
    def complete(self, prompts: pd.Series, model: str, temperature: float) -> pd.Series:
        """The model's answer, or None where there was none, for each prompt."""


@dataclass
class PromptSeries:
    """What is asked of whom. models has a model for each prompt; answers are kept in `store`, if it is given."""

    provider: ModelProvider
    models: tuple[str, ...]
    prompts: tuple[str, ...] = PROMPTS
    temperatures: tuple[float, ...] = (0.0, 0.0, 0.1)
    store: str | None = None


def _complete(provider: ModelProvider, text: str, model: str, temperature: float):
    @F.pandas_udf("string")
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield provider.complete(batch.map(lambda name: text.replace("{name}", name)), model, temperature)

    return complete


def ask_series(names: DataFrame, series: PromptSeries) -> DataFrame:
    """name, prompt, model and answer for the different names (name).

    A prompt goes out only for names that have no answer to it from its model yet, in one stage
    of Arrow batches for each prompt; what comes back is written before the next one, so a run
    that fails later asks nothing twice. Names without an answer are asked again by the next run.
    """
    spark = names.sparkSession
    known = stash(sinks.read_dictionary(spark, series.store, ANSWERS), "known") if series.store else spark.createDataFrame([], ANSWERS)
    different = names.select("name").where("name is not null").distinct()
    found = []
    for nth, (text, model, temperature) in enumerate(zip(series.prompts, series.models, series.temperatures)):
        had = known.where((F.col("prompt") == nth) & (F.col("model") == model))
        answer = _complete(series.provider, text, model, temperature)("name")
        asked = different.join(had, "name", "left_anti").select("name", F.lit(nth).alias("prompt"), F.lit(model).alias("model"), answer.alias("answer"))
        answered = stash(asked, "answers").where("answer is not null")  # a filter before that would ask twice
        if series.store and not answered.isEmpty():
            sinks.write_dictionary(sinks.read_dictionary(spark, series.store, ANSWERS).unionByName(answered), series.store)
        found.append(had.join(different, "name", "left_semi").unionByName(answered))
    return reduce(DataFrame.unionByName, found)


def vote_names(answers: DataFrame) -> DataFrame:
    """name, place and unanimous: each name's best answer. Names without a usable answer have no row."""
    scrubbed = stash(answers.select("name", "prompt", scrub_answer(F.col("answer"), F.col("name")).alias("result")), "scrubbed").where("result is not null")
    scored = scrubbed.withColumn("confidence", candidate_confidence(F.col("result"), F.col("name"), F.col("prompt")))
    return weighted_vote(scored, ["name"]).withColumnRenamed("winner", "place")


def names_by_series(names: DataFrame, series: PromptSeries) -> DataFrame:
    return vote_names(ask_series(names, series))
