"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of different k-word shingles. All documents order shingles in the same
way, rare ones first. A document with n shingles shares at least o = ceil(t * n) of them with
any document that reaches the similarity t, so that among its first n - o + m shingles, its
m-prefix, there are the first m that both have. Each document picks its own m: a longer
prefix costs more postings, and asks partners for more shared shingles. It takes the m with
the lowest estimate of postings read plus candidates verified. Each posting has its place in
its document's order. If a pair of sizes has to share o shingles, then the first m of them,
with the smaller m of the two, lie among the first n - o + m of each document, which for
documents of like size is much less than the whole prefix; and at each shared shingle, what
can come before it and after it must add up to o. Only postings that fit both count, and a
pair is verified if m of them do. No similar pair is missed.

How common a shingle is comes from a sketch of fixed size: every task counts the shingles
that it sees twice, and adds those counts by hash. It decides on the order and on m only,
so its errors cost time and never links.

Only whether documents hang together is asked, so a group of n near copies doesn't need
its n * n pairs. In each posting list the documents of like size are first compared with one
hub, the one whose shingles are the most common: among near copies that is the one with the
fewest changes. What is linked gets one label, and only documents of the same list whose
labels still differ are then compared with each other. Such a pair counts only if the
signatures of both allow it: the parities of 512 classes of shingles differ in no more places
than the sets may have shingles that only one of them has. Documents with the same set are
one node from the start.

A list of more than `BLOCK` postings is dealt out by pairs of blocks of it, and a shingle that
the sketch holds for that common is dealt by document before, so no task has a list whole.

Shingles are 64-bit hashes (textbatch.py). Defined results: a null or empty text has no
shingles and links with nothing; a text with fewer than k words has its whole sequence as
one shingle; a document without an id has a null component; of rows that repeat an id, each
has the size and component of its own text; no documents give no rows; further columns stay
out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import drop_stash, stash
from . import textbatch as tb
from .components import connected_components

SLOTS, CHUNK = 1 << 20, 1 << 12
DEEPEST, VERIFY_COST = 6, 8.0
TOKENS_IN_SHARD, LEAST_SHARDS, GROUP, MOST_SENT = 1_500_000, 256, 256, 1_000_000
BLOCK, SHORT = 20_000, 64
SIGNATURE = [f"s{i}" for i in range(8)]
NODE = np.dtype([("node", "<u8"), ("n", "<u4"), ("times", "<u4"), ("centre", "<u2"), ("m", "u1")])


def _sets(t: tb.Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles, where each text's start, their number, and a hash of each set (0 if empty)."""
    lower = tb.Texts(tb.LOWER[t.data], t.bounds)
    words = tb.words_of(lower)
    tokens, bounds = tb.shingles(tb.run_hashes(lower.data, words.start, words.end), words, k)
    n = np.diff(bounds)
    node = np.zeros(len(n), np.uint64)
    if len(tokens):
        node[n > 0] = tb.mix(np.add.reduceat(tb.mix(tokens ^ np.uint64(0x5DEECE66D)), bounds[:-1][n > 0]) ^ n[n > 0].astype(np.uint64)) | np.uint64(1)
    return tokens, bounds, n, node


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def _signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parities of the 512 classes of each set's shingles, as eight words."""
    rows = len(bounds) - 1
    at = np.repeat(np.arange(rows), np.diff(bounds)) * 512 + (tokens & np.uint64(511)).astype(np.int64)
    odd = np.bincount(at, minlength=rows * 512).reshape(rows, 512) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")


def _first_pass(k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, names = np.zeros(SLOTS, np.int64), [], ["doc_id", "n", "node", *SIGNATURE, "chunk", "counts"]

        def add() -> None:
            seen, times = np.unique(np.concatenate(held), return_counts=True)
            np.add.at(sketch, _slot(seen[times > 1]), times[times > 1])
            held.clear()

        for batch, t in tb.pieces(batches):
            tokens, bounds, n, node = _sets(t, k)
            held.append(tokens)
            if sum(map(len, held)) > 4_000_000:
                add()
            rows = batch.num_rows
            own = [batch.column("doc_id"), pa.array(n), pa.array(node.astype(np.int64)), *map(pa.array, np.ascontiguousarray(_signatures(tokens, bounds).T))]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if held:
            add()
        parts = sketch.reshape(-1, CHUNK).astype(np.uint32)
        used = np.flatnonzero(parts.any(axis=1))
        none = [pa.nulls(len(used), id_type), *[pa.nulls(len(used), pa.int64())] * (2 + len(SIGNATURE))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=names)

    return run


def _add_chunks(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.uint32).astype(np.int64) for b in rows["counts"])
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def _prefixes(k: int, percent: int, shards: int, sketch):
    """Each task's prefixes, packed by shard: tokens with their places, and for each node its size, its m, how common its shingles are, and its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sketch.value
        done: set[int] = set()
        toks, owners, infos, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            tok, own = np.concatenate(toks), np.concatenate(owners)
            place = np.concatenate([np.arange(len(x), dtype=np.uint32) for x in toks])
            info = np.array(infos, NODE)
            shard = ((tok ^ np.where(common[_slot(tok)] > BLOCK, tb.mix(info["node"][own]), np.uint64(0))) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            tok, own, shard, place = tok[order], own[order], shard[order], place[order]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            starts = np.concatenate([[0], cuts])
            out = {"shard": shard[starts], "tokens": [], "places": [], "nodes": []}
            for a, b in zip(starts, np.concatenate([cuts, [len(tok)]])):
                new = np.flatnonzero(np.concatenate([[True], own[a + 1 : b] != own[a : b - 1]]))
                rows = info[own[a:b][new]]
                rows["times"] = np.diff(np.concatenate([new, [b - a]]))
                out["tokens"].append(tok[a:b].tobytes())
                out["places"].append(place[a:b].tobytes())
                out["nodes"].append(rows.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(out["shard"]), *[pa.array(out[x], pa.binary()) for x in ("tokens", "places", "nodes")]], names=list(out))

        for _, t in tb.pieces(batches):
            tokens, bounds, n, node = _sets(t, k)
            weight = common[_slot(tokens)].astype(np.float64)
            for i in np.flatnonzero(n > 0):
                if (name := int(node[i])) in done:
                    continue
                done.add(name)
                w, x = weight[bounds[i] : bounds[i + 1]], tokens[bounds[i] : bounds[i + 1]]
                least = -(-percent * int(n[i]) // 100)
                shortest = int(n[i]) - least
                if w.any():
                    order = np.argsort(w, kind="stable")
                    deep = np.arange(1, min(DEEPEST, least) + 1)
                    read = np.cumsum(w[order])[shortest + deep - 1]
                    m = int(deep[(read + deep + VERIFY_COST * read / deep).argmin()])
                    x = x[order[: shortest + m]]
                else:
                    m, x = 1, x[: shortest + 1]
                toks.append(x)
                owners.append(np.full(len(x), len(infos)))
                infos.append((name, n[i], 0, int(1000 * np.log1p(w).mean()), m))
                size += len(x)
            if size > 2_000_000:
                yield flush()
                toks, owners, infos, size = [], [], [], 0
        if size:
            yield flush()

    return run


def _postings(sketch):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The lists of one shard that have two nodes at least, and what it has of the very common ones."""
        tok = np.concatenate([np.frombuffer(b, np.uint64) for b in rows["tokens"]])
        nodes = np.concatenate([np.frombuffer(b, NODE) for b in rows["nodes"]])
        place = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["places"]])
        at = np.repeat(np.arange(len(nodes)), nodes["times"])
        order = np.lexsort((nodes["node"][at], tok))
        tok, at, place = tok[order], at[order], place[order]
        node = nodes["node"][at]
        keep = np.ones(len(tok), bool)
        keep[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])  # several tasks may have met a copy
        tok, at, place = tok[keep], at[keep], place[keep]
        size = np.searchsorted(tok, tok, "right") - np.searchsorted(tok, tok, "left")
        long = (size > BLOCK) | (sketch.value[_slot(tok)] > BLOCK)
        many = (size > 1) | long
        info = nodes[at[many]]
        return pd.DataFrame({"token": tok[many].astype(np.int64), "node": info["node"].astype(np.int64), "n": info["n"].astype(np.int64), "m": info["m"].astype(np.int32), "centre": info["centre"].astype(np.int32), "place": place[many].astype(np.int32), "long": long[many]})

    return run


def _overlap(n: np.ndarray, other_n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles a similar pair of these sizes shares at least."""
    return -(-percent * (n + other_n) // (100 + percent))


def _needed(n: np.ndarray, m: np.ndarray, other_n: np.ndarray, other_m: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens the prefixes of a similar pair share at least."""
    overlap = _overlap(n, other_n, percent)
    rest = np.maximum(-(-percent * n // 100) - m, -(-percent * other_n // 100) - other_m)
    return np.maximum(overlap - rest, np.minimum(m, other_m))


def _hubs(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(node, hub, needed, times): in each list, the most central node of like size is the hub of the others."""
        for rows in batches:
            band = np.floor(np.log(rows["n"].to_numpy()) / -np.log(percent / 100)).astype(np.int64)
            tok, node = rows["token"].to_numpy(), rows["node"].to_numpy()
            order = np.lexsort((node, -rows["centre"].to_numpy(), band, tok))
            tok, band, node, n, m = tok[order], band[order], node[order], rows["n"].to_numpy()[order], rows["m"].to_numpy()[order]
            first = np.ones(len(tok), bool)
            first[1:] = (tok[1:] != tok[:-1]) | (band[1:] != band[:-1])
            at = np.flatnonzero(first)[np.cumsum(first) - 1][~first]
            needed = _needed(n[~first], m[~first], n[at], m[at], percent)
            yield pd.DataFrame({"node": node[~first], "hub": node[at], "needed": needed}).value_counts().rename("times").reset_index()

    return run


def _shard_pairs(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """(a, b, times, needed) of nodes in the same list whose labels, sizes, places and signatures allow a link."""
        rows = rows.sort_values(["token", "n", "node"], ignore_index=True)
        tok, node, n, m, place, label, block, cross = (rows[c].to_numpy() for c in ("token", "node", "n", "m", "place", "label", "block", "cross"))
        bits = np.ascontiguousarray(rows[SIGNATURE].to_numpy()).view(np.uint64)
        # The overlap that a partner of the same size asks for is the least for any that isn't shorter.
        counts = place < n - _overlap(n, n, percent) + m
        starts, ends = np.searchsorted(tok, tok, "left"), np.searchsorted(tok, tok, "right")
        longest = n * 100 // percent
        total: list[pd.DataFrame] = []
        held, size = [], 0

        def fold() -> None:
            d = pd.concat(held + total)
            total[:] = [d.groupby(["a", "b"], as_index=False).agg(times=("times", "sum"), needed=("needed", "min"))]
            held.clear()

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            """i before j in a list, so not the larger one."""
            nonlocal size
            ok = (label[i] != label[j]) & counts[i] & (n[j] <= longest[i]) & (~cross[i] | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            if not len(i):
                return
            least, needed = _overlap(n[i], n[j], percent), np.minimum(m[i], m[j])
            fits = (place[i] < n[i] - least + needed) & (place[j] < n[j] - least + needed)
            fits &= np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j]) >= least
            i, j, least, needed = i[fits], j[fits], least[fits], needed[fits]
            fits = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j] - 2 * least
            if fits.any():
                x, y = node[i[fits]], node[j[fits]]
                held.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "times": 1, "needed": needed[fits].astype(np.int64)}))
                size += int(fits.sum())
                if size > 1_000_000:
                    fold()
                    size = 0

        # Short lists all at once, by the distance of two postings in their list.
        i, step = np.flatnonzero(ends - starts <= SHORT), 1
        while len(i := i[i + step < ends[i]]):
            i = i[n[i + step] <= longest[i]]
            compare(i, i + step)
            step += 1
        # In a long list, those of its commonest label are not compared with each other.
        for a in np.unique(starts[ends - starts > SHORT]):
            b = ends[a]
            names, which, times = np.unique(label[a:b], return_inverse=True, return_counts=True)
            if len(names) > 1:
                rest = which != times.argmax()
                at = np.arange(a, b)
                for i in at[rest]:
                    j = at[~rest | (at > i)]
                    compare(np.minimum(i, j), np.maximum(i, j))
        if held:
            fold()
        return total[0] if total else pd.DataFrame({"a": [], "b": [], "times": [], "needed": []}).astype("int64")

    return run


def _verify(percent: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: one node's set; right: the sets to compare with it."""
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        own = np.frombuffer(left["tokens"].iloc[0], np.uint64)
        linked = []
        for name, raw in zip(right["b"], right["set"]):
            other = np.frombuffer(raw, np.uint64)
            small, large = (own, other) if len(own) <= len(other) else (other, own)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            if 100 * both >= percent * (len(own) + len(other) - both):
                linked.append(name)
        return pd.DataFrame({"a": np.full(len(linked), left["a"].iloc[0], np.int64), "b": np.array(linked, np.int64)})

    return run


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar.

    nodes has one doc_id of each node; the sets are worked out anew from those texts. A node
    with many partners is dealt out in groups.
    """
    pairs = stash(pairs, "ngram-pairs")
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stash(named.join(nodes, "node").select("doc_id"), "ngram-wanted")
    few = wanted.count() <= MOST_SENT
    sets = stash(texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").mapInArrow(_set_rows(k), "node long, tokens binary"), "ngram-sets")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"))
    right = dealt.join(sets.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("to"), F.col("part").alias("group"), "b", F.col("tokens").alias("set"))
    left = dealt.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), "tokens"), "a")
    links = stash(left.groupBy("a", "part").cogroup(right.groupBy("to", "group")).applyInPandas(_verify(percent), "a long, b long"), "ngram-links")
    drop_stash(pairs, wanted, sets)
    return links


def _dealt(labelled: DataFrame, shards: int) -> DataFrame:
    """labelled with shard, block and cross: whose postings are compared in one group.

    Those of a long list come once for each of its blocks, with the block that they are to meet."""
    usual = labelled.where("not long").select("*", F.pmod(F.xxhash64("token"), F.lit(shards)).alias("shard"), F.lit(0).cast("long").alias("block"), F.lit(False).alias("cross"))
    long = labelled.where("long")
    # A row for each BLOCK postings at most.
    sizes = long.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    parts = long.join(sizes, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    pair = F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other"))
    return usual.unionByName(parts.select(*labelled.columns, pair.alias("shard"), "block", (F.col("block") != F.col("other")).alias("cross")))


def similar_components(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each document."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    signature = ", ".join(f"{s} long" for s in SIGNATURE)
    kind = documents.schema["doc_id"].dataType
    first = stash(texts.mapInArrow(_first_pass(k, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n long, node long, {signature}, chunk int, counts binary"), "ngram-nodes")
    members = first.where("chunk is null").select("doc_id", F.col("n").alias("n_shingles"), "node")
    counts = first.where("chunk is not null").groupBy("chunk").applyInPandas(_add_chunks, "chunk int, counts binary").collect()
    sketch = np.zeros((SLOTS // CHUNK, CHUNK), np.uint32)  # of fixed size, whatever the corpus
    for row in counts:
        sketch[row["chunk"]] = np.frombuffer(row["counts"], np.uint32)
    sketch = spark.sparkContext.broadcast(sketch.reshape(-1))
    total = members.agg(F.sum(F.col("n_shingles") * (100 - percent) / 100 + 2)).first()[0] or 0
    shards = max(LEAST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // TOKENS_IN_SHARD))
    packed = texts.where("doc_id is not null").mapInArrow(_prefixes(k, percent, shards, sketch), "shard long, tokens binary, places binary, nodes binary")
    postings = stash(packed.groupBy("shard").applyInPandas(_postings(sketch), "token long, node long, n long, m int, centre int, place int, long boolean"), "ngram-postings")

    # A list may lie in two batches; each then has a hub of its own. Hubs see a part of what a pair
    # shares, and half of what it needs will do: which pairs are tried here decides on speed only.
    hubs = postings.mapInPandas(_hubs(percent), "node long, hub long, needed long, times long").groupBy("node", "hub").agg(F.sum("times").alias("times"), F.min("needed").alias("needed"))
    best = hubs.where("2 * times >= needed").groupBy("node").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
    nodes = first.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.min(s).alias(s) for s in SIGNATURE])
    links = _linked(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), nodes.select("node", "doc_id"), texts, k, percent)
    labels = connected_components(links)
    about = nodes.drop("doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = postings.drop("centre").join(about, "node")
    pairs = (
        _dealt(labelled, shards).groupBy("shard").applyInPandas(_shard_pairs(percent), "a long, b long, times long, needed long")
        .groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("needed").alias("needed")).where("times >= needed").select("a", "b")
    )
    more = _linked(pairs, nodes.select("node", "doc_id"), texts, k, percent)
    joined = connected_components(links.unionByName(more))
    drop_stash(postings, links, more, labels)
    found = members.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = found.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    return found.join(smallest, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id")
    )


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in tb.pieces(batches):
            tokens, bounds, n, node = _sets(t, k)
            full = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(node[full].astype(np.int64)), pa.array([tokens[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary())], names=["node", "tokens"])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
