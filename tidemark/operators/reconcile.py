"""Reconciling two extractions of the same statement into one ledger."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import best_description, description_score

FIELDS = ["place", "place_original", "amount"]


def reconcile(
    a: DataFrame, b: DataFrame, label_a: str = "A", label_b: str = "B", keys: tuple[str, ...] = ("doc_id", "txn_date"), order: str = "ordinal", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One-to-one full outer match on keys and the exact amount.

    The amount that counts is the row's own, else its debit or credit. A null key matches a null
    one, so a row whose date can't be read is matched like others; keys may be dates as printed.
    The n-th row of side A with a key and amount pairs with the n-th of side B. Merged rows have
    A's fields and the better description. Returns keys, amount, place, place_original, the
    columns to carry along, and extraction_method: "A+B", "A only" or "B only".
    """
    fields = ["amount", *carry]

    def side(df: DataFrame, second: bool) -> DataFrame:
        value = F.coalesce(*[F.col(c) for c in ("amount", "debits", "credits") if c in df.columns])
        names = F.struct("place", "place_original").alias("_names")
        return df.select(*keys, value.alias("_value"), F.lit(second).alias("_second"), F.col(order).alias("_order"), F.struct(*fields).alias("_row"), names)

    # One shuffle brings both sides together; then the two n-th rows stand side by side, A's first.
    group, second = Window.partitionBy(*keys, "_value"), F.col("_second")
    so_far = group.orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.when(second, F.count_if(second).over(so_far)).otherwise(F.count_if(~second).over(so_far))
    rows = side(a, False).unionByName(side(b, True)).withColumn("_nth", nth)
    pairs = group.orderBy("_nth", "_second")
    near = rows.withColumns({"_before": F.lag("_nth").over(pairs), "_after": F.lead("_nth").over(pairs), "_others": F.lead("_names").over(pairs)})
    near = near.where(~second | F.coalesce(F.col("_before") != F.col("_nth"), F.lit(True)))
    merged = ~second & F.coalesce(F.col("_after") == F.col("_nth"), F.lit(False))
    method = F.when(second, f"{label_b} only").when(merged, f"{label_a}+{label_b}").otherwise(f"{label_a} only")
    own, other = F.col("_names")["place_original"], F.col("_others")["place_original"]
    good = F.coalesce(own == other, F.lit(False)) | F.coalesce(description_score(own) >= description_score(other), F.lit(False))
    chosen = near.select(*keys, "_row", method.alias("extraction_method"), F.when(merged & ~good, F.col("_others")).otherwise(F.col("_names")).alias("_chosen"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in fields], F.col("_chosen")["place"].alias("place"), F.col("_chosen")["place_original"].alias("place_original"), "extraction_method")


def _stretches(a: DataFrame, b: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with stretch, the least of the amounts, in cents, that steps of at most `reach` lead to within a
    document's day, and kinds, the number of different amounts in it."""
    keys = ["doc_id", "txn_date"]
    cols = [*keys, *FIELDS, "ordinal"]
    a, b = (x.select(*cols, (F.col("amount") * 100).cast("long").alias("cents")) for x in (a, b))
    # Different amounts only, so a frequent one is one row here.
    seen = a.select(*keys, "cents").unionByName(b.select(*keys, "cents")).where("cents is not null").distinct()
    day = Window.partitionBy(*keys).orderBy("cents")
    begins = F.when(F.coalesce(F.col("cents") - F.lag("cents").over(day) > reach, F.lit(True)), F.col("cents"))
    seen = seen.withColumn("begins", begins).withColumn("stretch", F.last("begins", ignorenulls=True).over(day)).drop("begins")
    seen = seen.withColumn("kinds", F.count("*").over(Window.partitionBy(*keys, "stretch")))
    seen = seen.select(*[F.col(c).alias(f"of_{c}") for c in (*keys, "cents")], "stretch", "kinds")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]) & (F.col("cents") == F.col("of_cents"))
    return tuple(x.join(seen, same, "left").select(*[F.col(c).alias(c) for c in (*cols, "stretch", "kinds")]) for x in (a, b))


def reconcile_tolerant(a: DataFrame, b: DataFrame, cents: int = 1, strict: bool = False, label_a: str = "A", label_b: str = "B") -> DataFrame:
    """As reconcile(), for amounts that may differ by some cents.

    Each row of A, in order, takes the first row of B with its document and date that is free and
    near enough; null documents and dates are equal to null ones. The amount that counts is the
    row's own, else its debit or credit; a row without any stays alone. Only amounts that are
    joined by steps of near amounts can compete. Such a stretch of a document's day mostly has one
    amount: then the n-th row of A takes the n-th of B, by a join. Stretches of several amounts
    are walked, each by itself, in time linear in its rows. strict compares doubles as older
    ledgers did, where some gaps of two cents count as near.
    """
    a, b = (x.withColumn("amount", F.coalesce(*[F.col(c) for c in ("amount", "debits", "credits") if c in x.columns])) for x in (a, b))
    a, b = _stretches(a, b, 2 if strict else cents)
    schema = a.select("doc_id", "txn_date", *FIELDS).schema
    out_schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, extraction_method string, place_b string, original_b string"

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("ordinal"), right.sort_values("ordinal")
        others, rows = list(right.itertuples()), []
        free: dict[int, deque[int]] = {}  # the places of free rows by their cents, in order
        for i, y in enumerate(others):
            if pd.notna(y.amount):
                free.setdefault(int(y.amount * 100), deque()).append(i)
        alone = [i for i, y in enumerate(others) if pd.isna(y.amount)]
        reach = 2 if strict else cents

        def near(x, y) -> bool:
            return abs(float(x.amount) - float(y.amount)) < 0.02 if strict else abs(x.amount - y.amount) * 100 <= cents

        for x in left.itertuples():
            at = int(x.amount * 100) if pd.notna(x.amount) else None
            heads = [] if at is None else [(free[c][0], c) for c in range(at - reach, at + reach + 1) if free.get(c) and near(x, others[free[c][0]])]
            y = others[free[min(heads)[1]].popleft()] if heads else None
            rows.append((x.doc_id, x.txn_date, x.place, x.place_original, x.amount, f"{label_a}+{label_b}" if y else f"{label_a} only", y and y.place, y and y.place_original))
        rows += [(y.doc_id, y.txn_date, y.place, y.place_original, y.amount, f"{label_b} only", None, None) for y in (others[i] for i in sorted([*alone, *(i for d in free.values() for i in d)]))]
        return pd.DataFrame(rows, columns=["doc_id", "txn_date", *FIELDS, "extraction_method", "place_b", "original_b"])

    keys = ["doc_id", "txn_date"]
    walked = a.where("kinds > 1").groupBy(*keys, "stretch").cogroup(b.where("kinds > 1").groupBy(*keys, "stretch")).applyInPandas(match, out_schema)
    plain = [*keys, *FIELDS]

    def numbered(x: DataFrame, side: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy("ordinal"))
        return x.where("kinds = 1").select(*[F.col(c).alias(f"{c}_{side}") for c in (*plain, "stretch")], nth.alias(f"nth_{side}"), F.lit(True).alias(f"in_{side}"))

    same = [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in keys] + [F.col(f"{c}_a") == F.col(f"{c}_b") for c in ("stretch", "nth")]
    both = numbered(a, "a").join(numbered(b, "b"), reduce(lambda x, y: x & y, same), "full_outer")
    in_a, in_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    method = F.when(in_a & in_b, f"{label_a}+{label_b}").when(in_a, f"{label_a} only").otherwise(f"{label_b} only")
    second = [F.when(in_a, F.col(f"{c}_b")).alias(name) for c, name in (("place", "place_b"), ("place_original", "original_b"))]
    paired = both.select(*[F.when(in_a, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(c) for c in plain], method.alias("extraction_method"), *second)
    none = [F.lit(None).cast("string").alias(c) for c in ("place_b", "original_b")]
    done = walked.unionByName(paired)
    for x, label in ((a, label_a), (b, label_b)):
        done = done.unionByName(x.where("stretch is null").select(*plain, F.lit(f"{label} only").alias("extraction_method"), *none))
    other = F.col("original_b").isNotNull() & (best_description(F.col("place_original"), F.col("original_b")) != F.col("place_original"))
    return done.select(
        *keys, "amount", F.when(other, F.col("place_b")).otherwise(F.col("place")).alias("place"),
        F.when(other, F.col("original_b")).otherwise(F.col("place_original")).alias("place_original"), "extraction_method",
    )


def reconcile_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("extraction_method").agg(F.count("*").alias("n"))


def quality_score(rows: DataFrame, *keys: str) -> DataFrame:
    """How well each extraction went: score, valid and transaction_count by keys (such as doc_id and extractor).

    rows: txn_date_raw, place, amount, debits, credits. An empty extraction has no row here; see choose_source.
    """

    def share(test: Column) -> Column:
        return F.avg(F.coalesce(test, F.lit(False)).cast("int"))

    positive = F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("amount", "debits", "credits")]) > 0
    checks = rows.groupBy(*keys).agg(
        F.count("*").alias("transaction_count"), share(F.col("txn_date_raw").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")).alias("dates"), share(positive).alias("amounts"),
        share((F.length("place") >= 3) & F.col("place").rlike(r"\pL")).alias("places"), (F.count_distinct("place") / F.count("*")).alias("different"),
    )
    faults = [(F.col("dates") < 0.9, 20, "dates"), (F.col("amounts") < 0.9, 30, "amounts"), (F.col("places") < 0.8, 30, "places"), (F.col("transaction_count") < 3, 20, "few"), (F.col("different") < 0.5, 10, "repeated")]
    score = F.lit(100)
    for test, less, _ in faults:
        score = score - F.when(test, less).otherwise(0)
    issues = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in faults]))
    return checks.select(*keys, "transaction_count", F.greatest(F.lit(0), score).alias("score"), (score >= 50).alias("valid"), issues.alias("issues"))


def choose_source(scores: DataFrame, key: str = "doc_id", first: str = "A") -> DataFrame:
    """For each document the extractor with the best score, the first one on ties."""
    return scores.groupBy(key).agg(F.max_by("extractor", F.struct("score", (F.col("extractor") == first).alias("preferred"))).alias("extractor"))
