"""Exact top-k search by inner product over an M-tree of paged metric nodes.

Vectors of integers become points of a metric space by one more coordinate: with M the longest
norm, x gets sqrt(M**2 - |x|**2) and a query 0, so that the squared distance of a query q and a
point x is |q|**2 + M**2 - 2 * (q, x), and the nearest points are those of the largest product.

The tree's first level is a bounded number of routing rows, taken from all rows by a hash;
every row belongs to its nearest one. Rows of one routing row are dealt to shards of about
`shard` rows by a hash, so that thousands of equal rows take many shards. Each shard is an
M-tree: leaf pages of at most `page` rows; inner pages of routing rows, each with a covering
radius and its distance to the routing row above. Queries go best first, a block of them
together: of the open nodes the one whose ball is nearest to a query is next, for the queries
that it may still serve, until none can hold a row as near as a k-th best. By the triangle
inequality a child's or row's distance is at least the difference of the stored distance to its
parent and the query's own to that parent; those that this rules out for all queries aren't
worked out.

Queries are dealt to blocks by their routing row. First each block searches one shard of its
own, which bounds the k-th distances; then it goes to the shards of every routing row whose ball
holds something near enough for one of its queries. Scores are integer products, and rows that
tie with the k-th are never pruned, so results are exact.

Defined results: rows without a vec_id, or whose vector is null or holds null or non-finite
components, take no part; shorter vectors are filled up with zeros; components beyond +-2**24
after scaling count as that; rows that repeat a vec_id are queries and candidates each of its
own; with fewer than k candidates all are returned; no queries or rows give no rows; further
columns stay out of the result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .vectors import integer_vectors, matrix

MOST = 1 << 24
ROUTES, SHARD, BLOCK, PAGE, FANOUT = 256, 8192, 1024, 128, 32
NOTHING = np.iinfo(np.int64).min + 1


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {name: found[name] for name in found.files}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer rows, as int64; in floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1] < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Space:
    """Distances of points to points, and of queries to points."""

    def __init__(self, longest: int):
        self.top = float(longest)  # the largest squared norm
        self.slack = 1e-6 * (1 + self.top**0.5)  # more than all rounding of a distance
        self.kind = np.float64 if self.top < 2**52 else np.int64  # the faster type in which products are exact

    def points(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        aa, bb = (a.astype(np.int64) ** 2).sum(1), (b.astype(np.int64) ** 2).sum(1)
        flat = (aa[:, None] + bb[None, :] - 2 * product(a, b)).astype(np.float64)
        more = np.sqrt(np.maximum(self.top - aa, 0))[:, None] - np.sqrt(np.maximum(self.top - bb, 0))[None, :]
        return np.sqrt(np.maximum(flat + more**2, 0))

    def of_scores(self, squared: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squared + self.top - 2.0 * scores, 0))


class Tree:
    """The M-tree of one shard. Node 0 is the root; the children of a node, and the rows of a leaf, are neighbours."""

    def __init__(self, arrays: dict[str, np.ndarray], space: Space):
        self.space = space
        self.points, self.centre = arrays["points"].astype(space.kind), arrays["centre"].astype(space.kind)
        self.ids, self.rows, self.far, self.radius, self.parent = (arrays[x] for x in ("ids", "rows", "far", "radius", "parent"))
        self.first, self.last, self.leaf = (arrays[x].tolist() for x in ("first", "last", "leaf"))

    @staticmethod
    def build(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, space: Space, page: int = PAGE, fanout: int = FANOUT) -> dict[str, np.ndarray]:
        centres, radii, parents, firsts, lasts, leaves = [points[0]], [0.0], [0.0], [0], [0], [False]
        order, far, at = [], [], 0
        open_nodes = [(0, np.arange(len(points)))]
        while open_nodes:
            node, own = open_nodes.pop(0)
            away = space.points(points[own], centres[node][None])[:, 0]
            radii[node] = float(away.max())
            if len(own) <= page:
                order.append(own)
                far.append(away)
                firsts[node], lasts[node], leaves[node] = at, at + len(own), True
                at += len(own)
                continue
            picked, best = [int(own[0])], np.full(len(own), np.inf)
            nearest = np.zeros(len(own), np.int64)
            for i in range(min(fanout, -(-len(own) // page) * 2)):  # each next one is farthest from those before
                if i:
                    if best.max() <= space.slack:
                        break
                    picked.append(int(own[best.argmax()]))
                gap = space.points(points[own], points[picked[-1]][None])[:, 0]
                nearest[gap < best] = i
                best = np.minimum(best, gap)
            groups = [own[nearest == i] for i in range(len(picked))] if len(picked) > 1 else np.array_split(own, min(fanout, -(-len(own) // page)))
            firsts[node], lasts[node] = len(centres), len(centres) + len(groups)
            for i, group in enumerate(groups):
                centre = points[picked[i if len(picked) > 1 else 0]]
                centres.append(centre)
                radii.append(0.0)
                parents.append(float(space.points(centre[None], centres[node][None])[0, 0]))
                firsts.append(0)
                lasts.append(0)
                leaves.append(False)
                open_nodes.append((len(centres) - 1, group))
        by = np.concatenate(order)
        return {
            "points": points[by].astype(np.int32), "ids": ids[by], "rows": rows[by], "far": np.concatenate(far), "centre": np.array(centres, np.int32),
            "radius": np.array(radii), "parent": np.array(parents), "first": np.array(firsts), "last": np.array(lasts), "leaf": np.array(leaves),
        }

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the ids and scores of the k best rows, other than its own and no farther than its bound, and the k-th distance.

        Queries go together: the node that is nearest to one of them is next, for those that it may
        still serve. Places without a row have the score NOTHING.
        """
        space, q = self.space, queries.astype(self.space.kind)
        squared = (queries.astype(np.int64) ** 2).sum(1)
        bound = np.full(len(q), np.inf) if bound is None else bound.copy()
        scores, ids = np.full((len(q), k), NOTHING), np.full((len(q), k), np.iinfo(np.int64).max)
        to_root = space.of_scores(squared, q @ self.centre[0])
        heap = [(0.0, 0, to_root, to_root - self.radius[0])]
        while heap:
            least, node, dist, edge = heapq.heappop(heap)
            limit = bound + space.slack
            if least > limit.max():
                break
            some = np.flatnonzero(edge <= limit)
            if not len(some):
                continue
            a, b = self.first[node], self.last[node]
            dist, limit = dist[some], limit[some]
            if self.leaf[node]:
                near = a + np.flatnonzero((np.abs(dist[:, None] - self.far[a:b]) <= limit[:, None]).any(0))
                found = (q[some] @ self.points[near].T).astype(np.int64)
                found[self.rows[near] == own[some, None]] = NOTHING
                better = np.flatnonzero((found >= np.maximum(scores[some, -1:], NOTHING + 1)).any(1))
                rows = some[better]
                if len(rows):
                    both = np.concatenate([scores[rows], found[better]], 1)
                    names = np.concatenate([ids[rows], np.broadcast_to(self.ids[near], (len(rows), len(near)))], 1)
                    best = np.lexsort((names, -both), axis=1)[:, :k]
                    scores[rows], ids[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                    full = rows[scores[rows, -1] > NOTHING]
                    bound[full] = np.minimum(bound[full], space.of_scores(squared[full], scores[full, -1]))
                continue
            least_of = np.abs(dist[:, None] - self.parent[a:b]) - self.radius[a:b]
            near = a + np.flatnonzero((least_of <= limit[:, None]).any(0))
            away = space.of_scores(squared[some, None], q[some] @ self.centre[near].T)
            for i, child in enumerate(near.tolist()):
                whole = np.full((2, len(q)), np.inf)
                whole[0, some], whole[1, some] = away[:, i], away[:, i] - self.radius[child]
                if (whole[1, some] <= limit).any():
                    heapq.heappush(heap, (float(max(0.0, whole[1, some].min())), child, whole[0], whole[1]))
        return ids, scores, bound


def search(rows: DataFrame, k: int, every: int, routes: int = ROUTES, shard: int = SHARD, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """rows (row, vec_id, v) -> query_id, rank, vec_id, score; queries are the rows whose vec_id `every` divides.

    row is different for each row. Of routing rows there are `routes` at most.
    """
    spark = rows.sparkSession
    schema = "query_row long, query_id long, vec_id long, score long"
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long")))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space, wide = Space(longest), max(width, 1)

    some = rows.orderBy(F.xxhash64("row"), "row").select("v").limit(min(routes, -(-n // shard))).toPandas()["v"]
    table = np.zeros((len(some), wide), np.int64)
    for line, v in zip(table, some):
        line[: len(v)] = v
    table = np.unique(table, axis=0)
    sent = spark.sparkContext.broadcast(table)  # routes * width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = space.points(matrix(batch.column("v"), wide), sent.value)
            route = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route), pa.array(far[np.arange(len(far)), route])], names=[*batch.schema.names, "route", "away"])

    routed = stash(rows.select("row", "vec_id", "v").mapInArrow(assign, "row long, vec_id long, v array<int>, route long, away double"), "routed")
    asked = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    about = routed.groupBy("route").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.count_if(asked).alias("asked")).collect()  # a row for each routing row
    shards = {r["route"]: -(-r["n"] // shard) for r in about}
    blocks = {r["route"]: -(-r["asked"] // block) for r in about if r["asked"]}
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    radius = np.zeros(len(table))
    for r in about:
        radius[r["route"]] = r["radius"]

    def dealt(frame: DataFrame, counts: dict[int, int], name: str) -> DataFrame:
        """Rows of a routing row dealt to as many parts as it has."""
        many = spark.createDataFrame(list(counts.items()), "route long, parts long")
        return frame.join(F.broadcast(many), "route").withColumn(name, F.pmod(F.xxhash64("row"), "parts"))

    def plant(key: tuple, own: pa.Table) -> pa.Table:
        ids, at = (own.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "row"))
        tree = Tree.build(matrix(own.column("v").combine_chunks(), wide), ids, at, space, page)
        return pa.table({"route": [key[0].as_py()], "part": [key[1].as_py()], "tree": pa.array([pack(**tree)], pa.binary())})

    trees = stash(dealt(routed, shards, "part").select("route", "part", "row", "vec_id", "v").groupBy("route", "part").applyInArrow(plant, "route long, part long, tree binary"), "trees")

    def gather(key: tuple, own: pa.Table) -> pa.Table:
        queries = pack(points=matrix(own.column("v").combine_chunks(), wide).astype(np.int32), ids=own.column("vec_id").to_numpy(), rows=own.column("row").to_numpy())
        return pa.table({"route": [key[0].as_py()], "block": [key[1].as_py()], "queries": pa.array([queries], pa.binary())})

    asking = dealt(routed.where(asked), blocks, "block").select("route", "block", "row", "vec_id", "v").groupBy("route", "block").applyInArrow(gather, "route long, block long, queries binary")
    own_parts = spark.createDataFrame(list(shards.items()), "route long, parts long")
    asking = asking.join(F.broadcast(own_parts), "route").withColumn("part", F.expr("block % parts"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th distances in a shard of the block's own; then, for each routing row near enough, its shards and the queries that go there."""
        norms = (sent.value**2).sum(1)
        for batch in batches:
            for block_no, data, tree in zip(batch.column("block").to_pylist(), batch.column("queries").to_pylist(), batch.column("tree").to_pylist()):
                q, home = unpack(data), Tree(unpack(tree), space)
                bound = home.search(q["points"], q["rows"], k)[2]
                squared = (q["points"].astype(np.int64) ** 2).sum(1)
                away = np.sqrt(np.maximum(squared[:, None] + space.top - 2.0 * product(q["points"], sent.value), 0))
                for route in range(len(norms)):
                    go = away[:, route] - radius[route] <= bound + space.slack
                    if go.any() and route in shards:
                        part = pack(**{name: x[go] for name, x in q.items()}, bound=bound[go])
                        yield pa.RecordBatch.from_arrays([pa.array([block_no]), pa.array([route]), pa.array([shards[route]]), pa.array([part], pa.binary())], names=["block", "route", "parts", "queries"])

    tasks = min(4096, sum(shards.values()))  # searching is work of the CPU, so small inputs are spread too
    turns = max(1, sum(blocks.values()) // 256)  # blocks that meet in one task
    homes = asking.repartition(tasks, "route", "part").join(trees.repartition(tasks, "route", "part").hint("shuffle_hash"), ["route", "part"])
    going = homes.select("block", "queries", "tree").mapInArrow(bounded, "block long, route long, parts long, queries binary")
    going = going.select("route", "queries", F.expr(f"pmod(block, {turns})").alias("turn"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    there = trees.withColumn("turn", F.explode(F.expr(f"sequence(0L, {turns} - 1L)")))
    meet = ["route", "part", "turn"]
    met = going.repartition(tasks, *meet).join(there.repartition(tasks, *meet).hint("shuffle_hash"), meet)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, tree in zip(batch.column("queries").to_pylist(), batch.column("tree").to_pylist()):
                q, here = unpack(data), Tree(unpack(tree), space)
                ids, scores, _ = here.search(q["points"], q["rows"], k, q["bound"])
                of, _ = np.nonzero(there := scores > NOTHING)
                columns = [q["rows"][of], q["ids"][of], ids[there], scores[there]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_row", "query_id", "vec_id", "score"])

    found = met.select("queries", "tree").mapInArrow(answer, schema)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_products(embeddings: DataFrame, column: str = "embedding", scale: int = 64, k: int = 20, every: int = 20, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest inner products, for each row whose vec_id `every` divides."""
    vectors = integer_vectors(embeddings.where("vec_id is not null"), column, scale, MOST)
    rows = stash(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "v"), "points")
    return search(rows, k, every, **sizes)


def query(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """with kept as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 scored as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from kept q join kept c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
 select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored qualify rank <= 20"""
