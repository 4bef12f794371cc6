"""Rows told apart by all their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(rows: DataFrame, columns: list[str]) -> Column:
    """A hash of these columns of any type; null is another value than any that stands for it."""

    def value(name: str) -> Column:
        column = F.col(f"`{name}`")
        return F.to_json(F.struct(column)) if "map<" in rows.schema[name].dataType.simpleString() else column

    return F.xxhash64(*[value(c) for c in columns], *[F.col(f"`{c}`").isNull() for c in columns])
