"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes up to order 3: after a context of n occurrences
and d different next bytes, a byte seen c times there has the code length -log2(c / (n + d));
another byte costs the escape -log2(d / (n + d)) and is coded in the next shorter context,
down to a uniform one of 256 bytes. The statistics are frozen before scoring, so that a
text's code length under a language is exact, a sum over its bytes, and the language with
the shortest code wins. The score is that language's probability if all were equally likely.

Counts come from every training text, and every leaf is kept. A byte's code length depends on
the leaves whose context ends in the byte before it only, so trees are cut into shards by that
byte: a shard has the leaves after one byte, or after several as long as they are `most_leaves`
at most. With one shard, which is the usual case, documents are scored in one pass; with more,
each pass adds the code lengths of its shard's places to those of the passes before it, and the
trees are exact whatever their size. Inside a task, texts are scored together: four bytes are
one key, found in a hash table that has the code lengths of all languages side by side.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the
language that sorts first; repeated rows keep their own rows; no training texts make every
text `und`; no documents give no rows; further columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_stash, stash
from . import textbatch as tb

UNKNOWN = "und"
ORDER = 3


def _keys(t: tb.Texts) -> np.ndarray:
    """Each byte with the three before it (0 before a text's start), the byte itself lowest."""
    padded = np.zeros(len(t.data) + ORDER, np.uint32)
    padded[ORDER:] = t.data
    place = np.arange(len(t.data)) - np.repeat(t.bounds[:-1], np.diff(t.bounds))
    keys = padded[ORDER:].copy()
    for back in range(1, ORDER + 1):
        keys |= np.where(place >= back, padded[ORDER - back : len(padded) - back], np.uint32(0)) << np.uint32(8 * back)
    return keys


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n): a task's counts, folded together as it goes."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    for batch, t in tb.pieces(batches):
        keys = _keys(t)
        lang = batch.column("lang").dictionary_encode()
        code = np.repeat(lang.indices.to_numpy(), np.diff(t.bounds))
        for i, name in enumerate(lang.dictionary.to_pylist()):
            parts = held.setdefault(name, [])
            parts.append(np.unique(keys[code == i], return_counts=True))
            if len(parts) > 16:
                parts[:] = [fold(parts)]
    for name, parts in held.items():
        keys, n = fold(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "key", "n"])


def count_contexts(training: DataFrame) -> DataFrame:
    """(lang, size, key, n, total, kinds): leaves of size bytes, with the totals of their contexts."""
    texts = training.select("lang", "text").where("lang is not null and text is not null")
    longest = stash(texts.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "ppm-counts")
    leaves = None
    for size in range(1, ORDER + 2):
        own = longest if size > ORDER else longest.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        own = own.withColumn("context", F.shiftright("key", 8))
        about = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        kept = own.join(about, ["lang", "context"]).select("lang", F.lit(size).alias("size"), "key", "n", "total", "kinds")
        leaves = kept if leaves is None else leaves.unionByName(kept)
    return leaves


class Trees:
    """The code lengths of all languages' trees, in tables by key."""

    def __init__(self, langs: list[str], leaves: dict[str, np.ndarray], after: np.ndarray | None = None):
        """leaves: size, lang (a number), key, n, total and kinds; after: the bytes (of 256) whose places these trees are for, all if None."""
        self.langs, self.after = langs, after
        self.levels = []  # by order: keys, their code lengths, contexts, their escapes
        lower, low_keys = np.full((1, len(langs)), 8, np.float32), np.zeros(1, np.uint64)  # the uniform context
        for order in range(ORDER + 1):
            own = np.flatnonzero(leaves["size"] == order + 1)
            lang, n, whole, kinds = (leaves[x][own] for x in ("lang", "n", "total", "kinds"))
            keys, where = np.unique(leaves["key"][own].astype(np.uint64), return_inverse=True)
            above, context = np.unique(keys >> np.uint64(8), return_inverse=True)
            escape = np.zeros((len(above), len(langs)), np.float32)
            escape[context[where], lang] = -np.log2(kinds / (whole + kinds))
            cost = lower[np.searchsorted(low_keys, keys & np.uint64((1 << 8 * order) - 1)) if order else np.zeros(len(keys), int)]
            cost += escape[context]
            cost[where, lang] = -np.log2(n / (whole + kinds))
            self.levels.append((keys, cost, above, escape))
            low_keys, lower = keys, cost
        self.keys = self.levels[-1][0].astype(np.uint32)
        bits = max(10, int(np.ceil(np.log2(max(1, len(self.keys)) * 3))))
        while not self._hashed(bits):
            bits += 1

    def _hashed(self, bits: int, most_steps: int = 64) -> bool:
        """Gives every key one of the slots after its home; False if there are too few."""
        self.shift = np.uint32(32 - bits)
        self.slots = np.full((1 << bits) + most_steps, -1, np.int32)
        home = (self.keys * np.uint32(2654435769)) >> self.shift
        todo, self.steps = np.arange(len(self.keys)), 0
        while len(todo) and self.steps < most_steps:  # each round, one of the keys that want a free slot gets it
            want = home[todo] + self.steps
            free = self.slots[want] < 0
            self.slots[want[free]] = todo[free]
            todo, self.steps = todo[self.slots[want] != todo], self.steps + 1
        return not len(todo)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        home = (keys * np.uint32(2654435769)) >> self.shift
        out = np.full(len(keys), -1, np.int32)
        todo = None
        for step in range(self.steps):
            at = self.slots[home + step] if todo is None else self.slots[home[todo] + step]
            same = (at >= 0) & (self.keys[at] == (keys if todo is None else keys[todo]))
            if todo is None:
                out[same] = at[same]
                todo = np.flatnonzero((at >= 0) & ~same)
            else:
                out[todo[same]] = at[same]
                todo = todo[(at >= 0) & ~same]
            if not len(todo):
                break
        return out

    def _shorter(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of bytes that the tree of this order lacks in every language."""
        above, escape = self.levels[order][2:]
        context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
        at = np.minimum(np.searchsorted(above, context), len(above) - 1)
        out = np.where((above[at] == context)[:, None], escape[at], np.float32(0))
        if order == 0:
            return out + np.float32(8)
        table, cost = self.levels[order - 1][:2]
        key = keys & np.uint64((1 << 8 * order) - 1)
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        known = table[at] == key
        out[known] += cost[at[known]]
        if not known.all():
            out[~known] += self._shorter(keys[~known], order - 1)
        return out

    def bits(self, t: tb.Texts) -> np.ndarray:
        """The code length of each text under each language."""
        keys, bounds = _keys(t), t.bounds
        if self.after is not None:
            mine = self.after[(keys >> np.uint32(8)) & np.uint32(255)]
            keys, bounds = keys[mine], np.concatenate([[0], np.cumsum(mine)])[bounds]
        at = self.find(keys)
        table = self.levels[-1][1]
        total = np.zeros((len(bounds) - 1, len(self.langs)))
        lost = np.flatnonzero(at < 0)
        if len(lost):
            which, inverse = np.unique(keys[lost], return_inverse=True)
            own = self._shorter(which.astype(np.uint64), ORDER)
            table = np.concatenate([table, own])
            at[lost] = len(self.keys) + inverse
        full = np.diff(bounds) > 0
        if len(at):
            for i in range(len(self.langs)):
                total[full, i] = np.add.reduceat(table[:, i][at], bounds[:-1][full], dtype=np.float64)
        return total


def load_trees(contexts: DataFrame, most_leaves: int = 1_000_000) -> Iterator[Trees]:
    """The trees, shard by shard; none if nothing was learned.

    A shard has `most_leaves` leaves, or those after a single byte, and the leaves of order 0.
    """
    byte = F.when(F.col("size") > 1, F.shiftright("key", 8).bitwiseAND(F.lit(255)))
    contexts = stash(contexts.withColumn("after", byte), "ppm-leaves")
    langs = sorted(r["lang"] for r in contexts.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(langs)}
    sizes = sorted(tuple(r) for r in contexts.where("after is not null").groupBy("after").count().collect())  # 256 rows at most
    parts: list[list[int]] = []
    held = 0
    for after, n in sizes:
        if not parts or held + n > most_leaves:
            parts.append([])
            held = 0
        parts[-1].append(after)
        held += n
    for part in parts:
        rows = contexts.where(F.col("after").isNull() | F.col("after").isin(part)).drop("after").toArrow()
        own = rows.column("lang").combine_chunks().dictionary_encode()
        leaves = {c: rows.column(c).to_numpy() for c in rows.column_names if c != "lang"}
        leaves["lang"] = np.array([number[x] for x in own.dictionary.to_pylist()], int)[own.indices.to_numpy()]
        mine = None
        if len(parts) > 1:
            mine = np.isin(np.arange(256), part)
            if part is parts[0]:  # and the bytes after which there are no leaves
                mine |= ~np.isin(np.arange(256), [after for after, _ in sizes])
        del rows, own
        yield Trees(langs, leaves, mine)


def identify(documents: DataFrame, shards: Iterable[Trees]) -> DataFrame:
    """doc_id, lang_pred and score of each text."""
    spark, kind = documents.sparkSession, documents.schema["doc_id"].dataType.simpleString()
    rows, langs = documents.select("doc_id", "text"), []

    def add(sent, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, t in tb.pieces(batches, most=2 << 20):
                bits = sent.value.bits(t)
                if not first:
                    bits += np.array(batch.column("bits").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(list(bits), pa.list_(pa.float64()))], names=["doc_id", "text", "bits"])

        return run

    def predict(sent, passes: int, langs: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, t in tb.pieces(batches, most=2 << 20):
                letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\pL"), False).to_numpy(zero_copy_only=False)
                pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
                if langs:
                    bits = sent.value.bits(t)
                    if passes > 1:
                        bits += np.array(batch.column("bits").to_pylist())
                    best = bits.argmin(axis=1)
                    score = 1 / np.exp2(np.maximum(bits[np.arange(len(bits)), best][:, None] - bits, -1000)).sum(axis=1)
                    pred = np.array(langs, object)[best]
                    pred[~letters], score[~letters] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

        return run

    passes, waiting = 0, None
    for trees in shards:
        if waiting is not None:  # what is scored so far is written, so that a task holds one shard
            before = rows
            rows = stash(rows.mapInArrow(add(waiting, passes == 1), f"doc_id {kind}, text string, bits array<double>"), "ppm-bits")
            if passes > 1:
                drop_stash(before)
            waiting.unpersist()
        waiting, langs, passes = spark.sparkContext.broadcast(trees), trees.langs, passes + 1
    return rows.mapInArrow(predict(waiting, passes, langs), f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = load_trees(count_contexts(documents.where(~held_out(F.col("doc_id")))))
    return identify(documents, trees).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
