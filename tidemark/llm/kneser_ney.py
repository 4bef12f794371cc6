"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of bytes.

The model's n-grams are runs of `order` bytes of trusted texts: of all but one in five, by a
hash of the id, which are left for thresholds, as texts that a model was trained on look better
to it than they are. The longest have their counts, shorter ones the number of different bytes that come
before them; each order has its own three discounts, from how many n-grams occur once to four
times. Counting, contexts and the mixing with shorter orders are joins and groupings by
n-gram, so that every table is dealt out in shards by its key.

To score, the different n-grams of the corpus are looked up once: a seen one has its mixed
probability, another one the weight of its context times the probability one byte shorter.
That table, made by joins alone, is cut into shards of about `shard_rows` rows, a bound on
what goes to a task at once; for each shard the texts are read and their n-grams in it summed
up, and the sums of all shards make a document's code length. What is learned and looked up
grows with the corpus, what a task or the driver holds doesn't: a shard is released before
the next is sent. (A join of each document's n-grams with the table would shuffle a row for
nearly every byte of the corpus.)

A mean over a whole text hides a few bad words in it, so a document has a second figure, its
surprise: the bits that its bytes take beyond 8, what a byte costs without any model, less an
allowance of 8 for a single odd byte, which in a short text says little, by byte. Both are
made of sums over bytes, so shards add up to the same.

A document is kept if neither its perplexity nor its surprise is above the threshold of its
language: a quantile over the trusted documents in that language that were left out of
training, or over all of these if there are none.

Defined results: a null or empty text has no perplexity or surprise and isn't kept; a null language has
the overall threshold; rows equal in id, language and text come out as one, other rows that
repeat an id each have their own score; labels that are null count as not trusted; without trusted texts there is no
threshold, and every text that isn't empty is kept; documents without an id are scored one
by one and never trusted; no documents give no rows; further columns stay out of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stash
from . import textbatch as tb


KEY = ["doc_id", "lang", "mark"]
PLAIN = 8.0  # bits of a byte without a model
LEAST = 2.0**-64  # no byte is less likely: where counts give no discounts, nothing would be left for unseen ones


def _grams(t: tb.Texts, order: int) -> np.ndarray:
    """For each byte the run of `order` bytes that ends there; 0 stands before a text's start."""
    place = np.arange(len(t.data)) - np.repeat(t.bounds[:-1], np.diff(t.bounds))
    data = t.data.astype(np.uint64)
    out = data.copy()
    for back in range(1, order):
        out[back:] |= np.where(place[back:] >= back, data[: len(data) - back], np.uint64(0)) << np.uint64(8 * back)
    return out


def _count(order: int):
    """(gram, c) of a task, folded together as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, c, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate([g for g, _ in held] + [grams]), return_inverse=True)
            return keys, np.bincount(n, np.concatenate([x for _, x in held] + [c]), len(keys)).astype(np.int64)

        for _, t in tb.pieces(batches):
            held.append(np.unique(_grams(t, order), return_counts=True))
            if len(held) >= 12:
                grams, c = fold()
                held = []
        if held:
            grams, c = fold()
        for i in range(0, len(grams), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + 100_000].astype(np.int64)), pa.array(c[i : i + 100_000])], names=["gram", "c"])

    return run


def _low(gram: Column, size: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * size) - 1))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


def train(trusted: DataFrame, order: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """For the orders 1 to order: (gram, p) of seen grams, and (context, weight) of seen contexts."""
    counts = [stash(trusted.select("text").mapInArrow(_count(order), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), f"kn-counts-{order}")]
    for size in range(order - 1, 0, -1):
        before = counts[0].groupBy(_low(F.col("gram"), size).alias("gram")).agg(F.count("*").alias("c"))
        counts.insert(0, stash(before, f"kn-counts-{size}"))
    tables: list[tuple[DataFrame, DataFrame]] = []
    for size, table in enumerate(counts, 1):
        few = {r["c"]: r["n"] for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        n1, n2, n3, n4 = (few.get(i, 0) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        # With too few small counts for an estimate, a discount of one half to one and a half.
        d1, d2, d3 = (min(i, max(0.0, i - (i + 1) * y * b / a)) if a and n1 else i / 2 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = stash(table.groupBy(_context(F.col("gram")).alias("context")).agg(F.sum("c").alias("total"), F.sum(off).alias("off")), f"kn-contexts-{size}")
        seen = table.withColumn("context", _context(F.col("gram"))).join(contexts, "context")
        own, weight = (F.col("c") - off) / F.col("total"), F.col("off") / F.col("total")
        if size == 1:
            mixed = seen.select("gram", (own + weight / 256).alias("p"))
        else:
            shorter = tables[-1][0].select(F.col("gram").alias("short"), F.col("p").alias("q"))
            mixed = seen.withColumn("short", _low(F.col("gram"), size - 1)).join(shorter, "short").select("gram", (own + weight * F.col("q")).alias("p"))
        tables.append((stash(mixed, f"kn-mixed-{size}"), contexts.select("context", weight.alias("weight"))))
    return tables


def _lookup(wanted: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, bits) of all wanted grams: known ones at once, others by their contexts, order by order."""
    rows = wanted.select("gram", F.lit(1.0).alias("factor"), F.lit(None).cast("double").alias("p"))
    for size in range(len(tables), 0, -1):
        mixed, contexts = tables[size - 1]
        own = _low(F.col("gram"), size)
        rows = rows.withColumns({"key": own, "context": _context(own)})
        rows = rows.join(mixed.select(F.col("gram").alias("key"), F.col("p").alias("found")), "key", "left").join(contexts, "context", "left")
        missed = F.col("p").isNull() & F.col("found").isNull()
        rows = rows.select("gram", F.when(missed, F.col("factor") * F.coalesce("weight", F.lit(1.0))).otherwise(F.col("factor")).alias("factor"), F.coalesce("p", "found").alias("p"))
    return rows.select("gram", (-F.log2(F.greatest(F.col("factor") * F.coalesce("p", F.lit(1 / 256)), F.lit(LEAST)))).alias("bits"))


class _Shard:
    """A hash table from grams to bits."""

    def __init__(self, grams: np.ndarray, bits: np.ndarray):
        self.size = max(10, math.ceil(math.log2(max(1, len(grams)) * 3)))
        self.grams, self.bits = grams, np.append(bits, 0.0).astype(np.float32)
        self.slots = np.full((1 << self.size) + 256, -1, np.int32)
        home, todo, self.steps = self._home(grams), np.arange(len(grams)), 0
        while len(todo):
            want = home[todo] + self.steps
            free = self.slots[want] < 0
            self.slots[want[free]] = todo[free]
            todo = todo[self.slots[want] != todo]
            self.steps += 1

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.size)).astype(np.int64)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        home = self._home(grams)
        at = self.slots[home]
        todo = np.flatnonzero((at >= 0) & (self.grams[at] != grams))
        for step in range(1, self.steps):
            if not len(todo):
                break
            next_at = self.slots[home[todo] + step]
            at[todo] = next_at
            todo = todo[(next_at >= 0) & (self.grams[next_at] != grams[todo])]
        at[todo] = -1
        return self.bits[at]  # a gram of another shard ends at a free slot or after all steps, -1: no bits


def score(documents: DataFrame, tables: list[tuple[DataFrame, DataFrame]], shard_rows: int = 4_000_000) -> DataFrame:
    """doc_id, lang, mark (a hash of the text), n_bytes, bits and excess (bits of bytes beyond PLAIN) of each document."""
    order = len(tables)
    spark = documents.sparkSession
    wanted = documents.select("text").mapInArrow(_count(order), "gram long, c long").select("gram").distinct()
    table = stash(_lookup(wanted, tables), "kn-bits")
    shards = max(1, math.ceil(table.count() / shard_rows))
    kind = documents.schema["doc_id"].dataType.simpleString()
    sums = None
    for shard in range(shards):
        rows = table.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == shard).toArrow()
        grams = rows.column("gram").to_numpy().astype(np.uint64)
        sent = spark.sparkContext.broadcast((grams, rows.column("bits").to_numpy().astype(np.float32)))
        built: list[_Shard] = []

        def run(batches: Iterator[pa.RecordBatch], sent=sent, built=built) -> Iterator[pa.RecordBatch]:
            if not built:
                built.append(_Shard(*sent.value))
            for batch, t in tb.pieces(batches, most=2 << 20):
                bits, excess = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                full = np.diff(t.bounds) > 0
                if len(t.data):
                    each, starts = built[0].lookup(_grams(t, order)), t.bounds[:-1][full]
                    bits[full] = np.add.reduceat(each, starts, dtype=np.float64)
                    excess[full] = np.add.reduceat(np.maximum(each - PLAIN, 0), starts, dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KEY], pa.array(np.diff(t.bounds)), pa.array(bits), pa.array(excess)], names=[*KEY, "n_bytes", "bits", "excess"])

        part = documents.select("doc_id", "lang", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, lang string, mark long, n_bytes long, bits double, excess double")
        part = stash(part.withColumn("n_bytes", F.when(F.lit(shard == 0), F.col("n_bytes")).otherwise(0)), "kn-sums")
        sent.unpersist()
        sums = part if sums is None else sums.unionByName(part)
    # Of rows equal in all of the key, the sums are those of one.
    equal = F.count("*") / shards
    return sums.groupBy(*KEY).agg((F.sum("n_bytes") / equal).cast("long").alias("n_bytes"), *[(F.sum(c) / equal).alias(c) for c in ("bits", "excess")])


def classify(documents: DataFrame, labels: DataFrame, order: int = 5, quantile: float = 0.995, slack: float = 1.0, most_sent: int = 1_000_000) -> DataFrame:
    """doc_id, lang, trusted, perplexity, threshold, surprise, surprise_threshold and kept; slack times the quantiles are the thresholds."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).where("good").select("doc_id")
    good = stash(good, "kn-trusted")
    trusted = documents.join(F.broadcast(good) if good.count() <= most_sent else good, "doc_id", "left_semi")
    calibrates = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    scored = stash(score(documents, train(trusted.where(~calibrates), order)), "kn-scores")
    filled = F.col("n_bytes") > 0
    perplexity, surprise = F.when(filled, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes"))), F.when(filled, F.greatest(F.col("excess") - PLAIN, F.lit(0.0)) / F.col("n_bytes"))
    scored = scored.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left")
    scored = scored.select("doc_id", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), perplexity.alias("perplexity"), surprise.alias("surprise"))
    known = scored.where("trusted and perplexity is not null").where(calibrates)

    def quantiles(name: str) -> Column:
        return F.struct(*[F.percentile_approx(c, quantile, 10_000).alias(c) for c in ("perplexity", "surprise")]).alias(name)

    overall = known.agg(quantiles("overall"))
    by_lang = known.where("lang is not null").groupBy("lang").agg(quantiles("own"))
    out = scored.join(by_lang, "lang", "left").join(F.broadcast(overall), F.lit(True), "left")  # overall is one row
    out = out.withColumns({name: F.coalesce(f"own.{c}", f"overall.{c}") * slack for name, c in (("threshold", "perplexity"), ("surprise_threshold", "surprise"))})
    usual = F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("surprise") <= F.col("surprise_threshold")), F.lit(True))
    return out.select("doc_id", "lang", "trusted", "perplexity", "threshold", "surprise", "surprise_threshold", (F.col("perplexity").isNotNull() & usual).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
