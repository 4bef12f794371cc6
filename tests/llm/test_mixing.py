import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

from .conftest import COLUMNS, TABLES


def check_schedule(rows, weights, block, default=1):
    n = len(rows)
    assert sorted(r["mix_position"] for r in rows) == list(range(n))
    slots: dict[int, str] = {}
    for r in rows:
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
        assert slots.setdefault(r["mix_slot"], r["source"] or "(none)") == (r["source"] or "(none)")
    assert sorted(slots) == list(range(len(slots)))
    blocks = {s: -(-c // block) for s, c in Counter(r["source"] or "(none)" for r in rows).items()}
    total = sum(weights.get(s, default) for s in blocks)
    placed = Counter()
    for t in range(len(slots)):
        placed[slots[t]] += 1
        for s in blocks:
            assert abs(placed[s] - (t + 1) * weights.get(s, default) / total) < 1
        if any(placed[s] == blocks[s] for s in blocks):
            break  # from here on the others have new shares


def test_query(spark):
    rows = mixing.query(spark, TABLES).collect()
    assert len(rows) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    check_schedule(rows, mixing.WEIGHTS, 64)


@pytest.mark.parametrize("weights,counts", [({"a": 7, "b": 2, "c": 1}, {"a": 100, "b": 30, "c": 41}), ({"a": 1}, {"a": 5, "z": 17, "y": 1}), ({"a": 3, "b": 3}, {"a": 9})])
def test_deviation_stays_below_one_block(spark, weights, counts):
    rows = [(i, s) for s, c in counts.items() for i in range(c)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    check_schedule(mixing.mix_sources(df, weights, block=4).collect(), weights, 4)


def brute_schedule(counts: dict[str, int], weights: dict[str, int], block: int) -> list[tuple[str, int]]:
    """(source, block) slot by slot: of the blocks released so far, the one with the earliest deadline, by exact fractions."""
    left = {s: -(-n // block) for s, n in counts.items()}
    done, out = dict.fromkeys(left, 0), []
    while left:
        total, start, own = sum(weights.get(s, 1) for s in left), len(out), dict.fromkeys(left, 0)
        while all(left.values()):
            t = len(out) - start
            ready = [(math.ceil(Fraction((own[s] + 1) * total, weights.get(s, 1))), s) for s in left if math.floor(Fraction(own[s] * total, weights.get(s, 1))) <= t]
            s = min(ready)[1]
            out.append((s, done[s]))
            own[s], done[s], left[s] = own[s] + 1, done[s] + 1, left[s] - 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_schedules_agree_with_brute_force(spark):
    rng = random.Random(2)
    for _ in range(4):
        counts = {f"s{i}": rng.randrange(1, 120) for i in range(rng.randrange(1, 7))}
        weights = {s: rng.randrange(1, 9) for s in list(counts)[:5]}
        df = spark.createDataFrame([(None if i % 3 else i, s) for s, c in counts.items() for i in range(c)], "doc_id long, source string")
        rows = mixing.mix_sources(df, weights, block=5).collect()
        slots = brute_schedule(counts, weights, 5)
        assert {(r["mix_slot"], r["source"], r["mix_block"]) for r in rows} == {(t, s, k) for t, (s, k) in enumerate(slots)}
        assert sorted((r["mix_position"], r["mix_slot"]) for r in rows) == [(p, t) for p, t in enumerate(t for t, (s, k) in enumerate(slots) for _ in range(min(5, counts[s] - 5 * k)))]


def test_odd_rows(spark, odd_documents):
    out = mixing.mix_sources(odd_documents, {"src0": 2}, block=2)
    assert out.count() == odd_documents.count() and set(out.columns) == set(odd_documents.columns) | set(mixing.NEW)
    check_schedule(out.collect(), {"src0": 2}, 2)
    kept = [c for c in odd_documents.columns if c not in mixing.NEW]
    assert out.select(kept).exceptAll(odd_documents.select(kept)).isEmpty()
    assert mixing.mix_sources(spark.createDataFrame([], COLUMNS), {}).count() == 0


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        mixing.mix_sources(spark.createDataFrame([], COLUMNS), {"a": 0})
    assert mixing.mix_sources(spark.createDataFrame([(1, "a")], "doc_id long, source string"), {"b": 3}).select(F.max("mix_position")).first()[0] == 0
