"""Quality rules: text statistics and a learned decision list.

Each text is described by counts. A decision list is learned from labelled texts by
sequential covering: a rule is a conjunction of thresholds on ratios of those counts, grown
greedily on two thirds of the labelled rows, pruned on the other third, and taken only if
it is almost always right there; the rows that it covers are put aside and the next rule is
grown. The list becomes one Spark conditional expression whose first matching rule rejects.

The list is fitted on max_labelled labelled texts at most (all if there are fewer), chosen by
a hash of the document id and then of the row; rows that are equal in id and ratios teach once.
Statistics and verdicts cover every text in full.

Defined results: a null or empty text has no words and fails the base rules; labels that
are null, or of documents that are not there, count for nothing; of several labels of one
document the lowest counts; without labels of both kinds no rule is learned; repeated rows
keep their own rows; no documents give no rows; further columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbatch as tb

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]
WINDOW = 5


def _table(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


SYMBOLS, UPPER, DIGITS, MARKS = _table("#*$%&|<>"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table("!?;:\"()[]{}=+_~^\\/@")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, t in tb.pieces(batches):
        n, words = batch.num_rows, tb.words_of(t)
        inside = ~tb.SPACE[t.data]
        out = {
            "n_words": np.diff(words.first),
            "word_chars": tb.per_text(inside & ((t.data & 0xC0) != 0x80), t.bounds),
            "n_symbols": tb.per_text(SYMBOLS[t.data], t.bounds), "n_upper": tb.per_text(UPPER[t.data], t.bounds),
            "n_digits": tb.per_text(DIGITS[t.data], t.bounds), "n_marks": tb.per_text(MARKS[t.data], t.bounds),
        }
        breaks = np.flatnonzero(t.data == 0x0A)
        start = np.sort(np.concatenate([t.bounds[:-1], breaks + 1]))
        end = np.sort(np.concatenate([t.bounds[1:], breaks]))
        # An empty text next to a break sorts as it should: its start and end are equal.
        full = tb.per_text(inside, np.concatenate([start, t.bounds[-1:]])) > 0 if len(start) else np.zeros(0, bool)
        start, end = start[full], end[full]
        text = np.searchsorted(t.bounds, start, "right") - 1
        salt = tb.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        lines = np.bincount(text, minlength=n)
        _, one = np.unique(tb.mix(tb.run_hashes(t.data, start, end) ^ salt[text]), return_index=True)
        out["n_lines"], out["n_dup_lines"] = lines, lines - np.bincount(text[one], minlength=n)
        runs, at = tb.windows(tb.run_hashes(t.data, words.start, words.end), words, WINDOW)
        again = np.zeros(len(words.start) + 1, np.int64)
        if len(runs):
            _, which, times = np.unique(tb.mix(runs ^ salt[words.text[at]]), return_inverse=True, return_counts=True)
            often = at[times[which] > 1]
            np.add.at(again, often, 1)
            np.add.at(again, often + WINDOW, -1)
        out["n_repeat_words"] = tb.per_text(np.cumsum(again[:-1]) > 0, words.first)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"] + [pa.array(out[c].astype(np.int64)) for c in COUNTS],
            names=[c for c in batch.schema.names if c != "text"] + COUNTS,
        )


def text_counts(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of each text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    """Too few words, or too large a part of them in windows that occur again."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Ratios that rules may test: name, numerator, denominator.
RATIOS = [
    ("symbols_per_word", "n_symbols", "n_words"), ("chars_per_word", "word_chars", "n_words"), ("repeated_words", "n_repeat_words", "n_words"),
    ("duplicate_lines", "n_dup_lines", "n_lines"), ("upper_case", "n_upper", "word_chars"), ("digits", "n_digits", "word_chars"), ("marks_per_word", "n_marks", "n_words"),
]


def ratio_columns() -> list[Column]:
    return [F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).alias(name) for name, a, b in RATIOS]


Rule = list[tuple[str, str, float]]  # (ratio, ">" or "<=", threshold)


def _covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, side, at in rule:
        hit &= (x[name] > at).to_numpy() if side == ">" else (x[name] <= at).to_numpy()
    return hit


def _best_condition(x: pd.DataFrame, bad: np.ndarray) -> tuple[float, tuple[str, str, float]] | None:
    """The threshold with the highest information gain for the bad rows."""
    base, best = np.log2(bad.mean()), None
    for name in x.columns:
        order = np.argsort(x[name].to_numpy(), kind="stable")
        v, b = x[name].to_numpy()[order], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        for side in (">", "<="):
            p = (b[::-1].cumsum()[::-1][cut + 1] if side == ">" else b.cumsum()[cut]).astype(float)
            size = len(v) - cut - 1 if side == ">" else cut + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / size) - base), -np.inf)
            if len(gain) and (best is None or gain.max() > best[0]):
                i = int(gain.argmax())
                best = (float(gain[i]), (name, side, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def learn_decision_list(x: pd.DataFrame, bad: np.ndarray, precision: float = 0.95, least: int = 5, most_rules: int = 12) -> list[Rule]:
    """Sequential covering: rules for the bad rows, in order."""
    held = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (bad & left & ~held).sum() >= least:
        gx, gb = x[left & ~held], bad[left & ~held]
        rule: Rule = []
        while len(rule) < 4 and 0 < gb.mean() < 1 and (found := _best_condition(gx, gb)) and found[0] > 1e-9:
            rule.append(found[1])
            hit = _covers([found[1]], gx)
            gx, gb = gx[hit], gb[hit]
        px, pb = x[left & held], bad[left & held]

        def worth(r: Rule) -> tuple[float, int]:
            hit = _covers(r, px)
            return (2 * pb[hit].sum() - hit.sum()) / max(1, hit.sum()), -len(r)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=[])
        hit, seen = _covers(rule, x) & left, _covers(rule, px)
        if not rule or seen.sum() < max(1, least // 3) or pb[seen].mean() < precision or bad[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """The number of the first rule that matches (from 1), or null."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, side, at in rule:
            test &= F.col(name) > at if side == ">" else F.col(name) <= at
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def learn_from_labels(documents: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> list[Rule]:
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = max_labelled / max(1, marked.count())
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About max_labelled ids at most, so that they may go to every task.
    texts = documents.join(F.broadcast(marked), "doc_id", "left_semi")
    ratios = [r[0] for r in RATIOS]
    rows = text_counts(texts).join(F.broadcast(marked), "doc_id").where(~base_failed()).select("doc_id", "quality", *ratio_columns()).distinct()
    rows = rows.orderBy(F.xxhash64("doc_id", *ratios)).limit(max_labelled).toPandas()
    rows["order"] = pd.util.hash_array(rows["doc_id"].to_numpy().astype(str).astype(object))
    rows = rows.sort_values(["order", *ratios])
    bad = (rows["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    return learn_decision_list(rows[ratios], bad)


def judge_quality(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The counts of each text, base_failed, rule (the number of the rule that rejects it) and kept."""
    return (
        text_counts(documents)
        .select("doc_id", *COUNTS, base_failed().alias("base_failed"), *ratio_columns())
        .withColumn("rule", rules_column(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def keep_good(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows, with all their columns, whose texts are kept. Counts ride along with the rows."""
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("text"))
    counted = whole.mapInArrow(_count, T.StructType([T.StructField("row", documents.schema), *[T.StructField(c, T.LongType()) for c in COUNTS]]))
    judged = counted.select("row", base_failed().alias("base_failed"), *ratio_columns()).withColumn("rule", rules_column(rules))
    return judged.where(~F.col("base_failed") & F.col("rule").isNull()).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = judge_quality(documents, learn_from_labels(documents, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
