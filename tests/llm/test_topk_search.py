"""The M-tree search against products of all with all."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk_search
from tidemark.llm.topk_search import Space, Tree

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, every):
    kept = [(i, [max(-(1 << 24), min(1 << 24, math.floor(64 * float(np.float32(x))))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(kept) if other != at)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def rows_of(rng, n, wide=6):
    centres = rng.normal(0, 1, (5, wide))
    rows = [(int(i), [float(x) for x in centres[i % 5] + rng.normal(0, 0.2, wide)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]  # a third are copies
    return rows + [(n * 2 + i, [0.0] * wide) for i in range(9)]


@pytest.mark.parametrize("sizes", [{}, {"routes": 6, "shard": 40, "block": 7, "page": 8}])
def test_search_against_all_products(spark, sizes):
    rows = rows_of(np.random.default_rng(3), 300)
    rows += [(20, [1.0] * 6), (20, [1.0] * 6), (None, [1.0] * 6), (40, None), (60, [1.0, None]), (80, [math.nan] * 6), (100, [math.inf] * 6), (120, [2.0]), (140, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("v", "row", "route", "part", "score", "rank"):
        df = df.withColumn(name, F.lit("x"))
    got = topk_search.top_products(df, k=20, every=20, **sizes).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 20, 20)


def test_few_and_huge(spark):
    rows = [(0, [3e38, 1.0]), (20, [-3e38, 2.0]), (3, [5.0, 5.0])]
    got = topk_search.top_products(spark.createDataFrame(rows, SCHEMA), k=20, every=20).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 20, 20) and len(got) == 4
    assert topk_search.top_products(spark.createDataFrame([(1, [1.0]), (2, [1.0])], SCHEMA)).count() == 0
    assert topk_search.top_products(spark.createDataFrame([(20, [1.0])], SCHEMA)).count() == 0
    assert topk_search.top_products(spark.createDataFrame([(20, None)], SCHEMA)).count() == 0


def test_the_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-40, 40, (1500, 2)), np.full((600, 2), 7), rng.integers(900, 940, (900, 2))])
    space = Space(int((points**2).sum(1).max()))
    ids = rng.permutation(len(points)).astype(np.int64)
    arrays = Tree.build(points, ids, np.arange(len(points)), space, page=16, fanout=8)
    tree = Tree(arrays, space)
    assert sorted(arrays["rows"]) == list(range(len(points))) and len(arrays["leaf"]) > 50
    for own in (0, 1499, 1600, 2500):
        scores = points @ points[own]
        best = sorted((-int(s), int(ids[i])) for i, s in enumerate(scores) if i != own)[:20]
        got_ids, got_scores, _ = tree.search(points[[own]], np.array([own]), 20)
        assert [(-int(s), int(i)) for s, i in zip(got_scores[0], got_ids[0])] == best
