"""Annular search and codebooks against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import vector_codes
from tidemark.llm.vector_codes import Annulus

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """code and error of each kept row, as the docstring says, by trying every entry."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(float(np.float32(x)) * 1024))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = [[(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in cut:
                own.setdefault(nearest(p, x[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else old for e, old in enumerate(books[p])]
    found = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
    return sorted(((k[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), k[2]) for k, f in zip(kept, found)), key=str)


def test_annulus_finds_the_lowest_nearest_entry():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 256):
        entries = rng.integers(-6, 6, (size, 3))
        x = np.concatenate([rng.integers(-9, 9, (400, 3)), entries, entries[::-1], np.zeros((2, 3), np.int64), np.full((1, 3), 1 << 27)])
        far = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        at, best = Annulus(entries).nearest(x, step=2)
        assert (at == far.argmin(1)).all() and (best == far.min(1)).all()


def test_codes_against_plain_loops(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.01, 8)], int(i) % 3 or None) for i in rng.permutation(400)]
    rows += [(1, rows[0][1], 1), (1, rows[0][1], 1), (None, rows[3][1], 2), (401, None, 1), (402, [1.0, None] * 4, 1), (403, [math.nan] * 8, 1), (404, [math.inf] * 8, 1), (405, [0.5] * 3, 2), (406, [], 2), (407, [3e38, -3e38] * 4, 2)]
    rows += [(500 + i, [0.25] * 8, 7) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("v", "code", "error", "n", "of", "part"):
        df = df.withColumn(name, F.lit("x"))
    got = vector_codes.compress(df).collect()
    expected = plain(rows)
    labels = {}
    for _, _, e, label in expected:
        labels[label] = labels.get(label, 0) + e
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=str) == sorted(((i, c, e) for i, c, e, _ in expected), key=str)
    assert sorted(r["label_error"] for r in got) == sorted(labels[label] for *_, label in expected)
    assert len({r["codebooks_sha256"] for r in got}) == 1


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert vector_codes.compress(df).count() == 0 and vector_codes.compress(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
