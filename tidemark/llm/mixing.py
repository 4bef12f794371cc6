"""Mixing sources to target weights, by Pfair scheduling of blocks.

The documents of a source, in the order of a hash of their rows, form blocks of a fixed
size. Time is a row of slots that take one block each. A source with the share w of all
weights may place its k-th block (from 1) from slot floor((k - 1) / w) on and has to before
slot ceil(k / w); in each slot the block with the earliest deadline among those released goes
first. After any number t of slots each source has placed its share t * w give or take less
than one block. When a source runs out, the others go on with the weights that they have
among themselves, and the clock of releases and deadlines starts anew, until every document
has its place: none is left out and none is repeated.

The schedule repeats after as many slots as the weights add up to, so only that pattern is
worked out on the driver, from the sources' weights and counts. All else are expressions over
rows: a row's rank in its source comes from counts of small hash ranges, so that a source
with a third of all rows is numbered by many tasks.

Defined results: a null source is the source "(none)"; rows that repeat an id, and rows
without one, each have a place, in the order of their hash like others; weights of sources that aren't
there count for nothing, sources without a weight have `default`; no documents give no rows;
all columns stay, and columns named like the new ones are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import row_hash

RANGE = 4096  # documents in a hash range, on average
NEW = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")


def pattern(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Earliest deadline first over one period: the slots of each source's blocks."""
    period = sum(weights.values())
    starts: list[list[tuple[int, str]]] = [[] for _ in range(period)]
    for name, w in weights.items():
        for k in range(w):
            starts[k * period // w].append((-(-(k + 1) * period // w), name))
    ready: list[tuple[int, str]] = []
    slots: dict[str, list[int]] = {name: [] for name in weights}
    for t in range(period):
        for job in starts[t]:
            heapq.heappush(ready, job)
        deadline, name = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError(f"{name} missed the deadline {deadline}")
        slots[name].append(t)
    return slots


def plan(counts: Mapping[str, int], weights: Mapping[str, int], block: int, default: int = 1) -> list[dict]:
    """For each source the phases it takes part in: (first block, first slot, weight, period, gap, slots).

    A source's last block may be short; as it ends a phase, `gap` is what all blocks of a phase move up by."""
    left = {s: -(-n // block) for s, n in counts.items() if n > 0}
    done, slot, gap = dict.fromkeys(left, 0), 0, 0
    phases: dict[str, list[tuple]] = {s: [] for s in left}
    while left:
        own = {s: weights.get(s, default) for s in sorted(left)}
        shrink = math.gcd(*own.values())
        own = {s: w // shrink for s, w in own.items()}
        period, slots = sum(own.values()), pattern(own)
        ends = {s: (n - 1) // own[s] * period + slots[s][(n - 1) % own[s]] + 1 for s, n in left.items()}
        length = min(ends.values())
        for s in list(left):
            phases[s].append((done[s], slot, own[s], period, gap, slots[s]))
            placed = length // period * own[s] + sum(t < length % period for t in slots[s])
            done[s] += placed
            left[s] -= placed
            if not left[s]:
                del left[s]
                ended = -counts[s] % block
        slot, gap = slot + length, gap + ended
    return [{"source": s, "ranges": max(1, counts[s] // RANGE), "phases": p} for s, p in phases.items()]


def mix_sources(
    documents: DataFrame, weights: Mapping[str, int], block: int = 64, default: int = 1, max_sources: int = 10_000, max_weight: int = 1_000_000
) -> DataFrame:
    """All rows and columns, with each row's block, its release, deadline and slot, and its place among all rows."""
    if any(int(w) != w or w < 1 for w in (*weights.values(), default)):
        raise ValueError("weights have to be positive integers")
    source = F.coalesce("source", F.lit("(none)"))
    counted = documents.groupBy(source.alias("source")).count().limit(max_sources + 1).collect()
    counts = {r["source"]: r["count"] for r in counted}
    if len(counts) > max_sources or sum(weights.get(s, default) for s in counts) > max_weight:
        raise ValueError("more sources, or larger weights, than a pattern is worked out for")
    planned = plan(counts, weights, block, default)
    schema = "source string, ranges long, phases array<struct<first:long,slot:long,weight:long,period:long,gap:long,slots:array<long>>>"
    plans = documents.sparkSession.createDataFrame([(p["source"], p["ranges"], p["phases"]) for p in planned], schema)
    # Ids may be null or repeat: those rows are told apart, and dealt out, by all their columns.
    kept = [c for c in documents.columns if c not in NEW]
    mark = row_hash(documents, ["doc_id", *[c for c in kept if c != "doc_id"]])
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), source.alias("source"), mark.alias("hash"))
    # At most max_sources rows, so they may go to every task.
    ranges = F.broadcast(plans.drop("phases"))
    rows = rows.join(ranges, "source").withColumn("range", F.shiftright(F.shiftrightunsigned("hash", 33) * F.col("ranges"), 31)).drop("ranges")
    sizes = documents.select(source.alias("source"), mark.alias("hash")).join(ranges, "source")
    sizes = sizes.groupBy("source", F.shiftright(F.shiftrightunsigned("hash", 33) * F.col("ranges"), 31).alias("range")).count()
    before = F.sum("count").over(Window.partitionBy("source").orderBy("range")) - F.col("count")
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("source", "range").orderBy("hash", "row.doc_id")) - 1).join(
        sizes.select("source", "range", before.alias("before")), ["source", "range"]
    )
    rank = F.col("before") + F.col("at")
    k = F.floor(rank / block).cast("long")
    # The schedule joins the rows after their last shuffle; each row takes its own phase and slot out of it.
    placed = ranked.select("row", "source", k.alias("k"), F.pmod(rank, F.lit(block)).alias("inside")).join(F.broadcast(plans.drop("ranges")), "source")
    placed = placed.withColumn("phase", F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("k")), -1))
    j, w, period = F.col("k") - F.col("phase.first"), F.col("phase.weight"), F.col("phase.period")
    placed = placed.select(
        "row", "k", "inside", F.col("phase.gap").alias("gap"),
        (F.col("phase.slot") + F.expr("(k - phase.first) * phase.period div phase.weight")).alias("release"),
        (F.col("phase.slot") - F.floor(-((j + 1) * period) / w)).cast("long").alias("deadline"),
        (F.col("phase.slot") + F.expr("(k - phase.first) div phase.weight * phase.period") + F.get(F.col("phase.slots"), F.pmod(j, w).cast("int"))).alias("slot"),
    )
    return placed.select(
        "row.*", F.col("k").alias("mix_block"), F.col("release").alias("mix_release"), F.col("deadline").alias("mix_deadline"), F.col("slot").alias("mix_slot"),
        (F.col("slot") * block + F.col("inside") - F.col("gap")).alias("mix_position"),
    )


WEIGHTS = {"src0": 5, "src1": 3, "src2": 3, "src3": 2}


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(documents, WEIGHTS)
