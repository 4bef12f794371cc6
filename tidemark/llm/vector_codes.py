"""Vector code compression: a vector as one byte for each of its parts, from learned codebooks.

Vectors of integers are cut into equal parts. Each part position has a codebook of at most 256
entries, which starts as that part of the vectors with the smallest ids and is refined by
rounds: every part goes to its nearest entry, and every entry becomes the floor of the mean of
its parts. All of it is integer arithmetic, so results don't depend on how rows are dealt.

The nearest entry is found by annular norm pruning: entries are sorted by norm; as a part x and
an entry c are at least | |x| - |c| | apart, only entries whose norm is within the best distance
so far of the part's own can win or tie. The search starts at the part's norm, goes outwards a
few entries at a time, and after each step narrows the interval, ends included, by binary
search. What is left in it is evaluated exactly.

Each round reads the vectors once; a task returns one sum and count for each entry, so the
driver sees 256 * parts entries, whatever the number of vectors.

Defined results: rows whose vector is null or holds a null or non-finite component go; shorter
vectors, and lengths that the number of parts doesn't divide, are filled up with zeros;
components beyond +-2**27 after scaling count as that; rows with one id start the codebooks in
the order of their vectors, and those without an id come last; equal distances go to the lower
entry; an entry without parts stays; repeated rows keep their own rows; no vectors give no
rows; sums of errors beyond a long are null. Columns other than these stay out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .vectors import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 27


class Annulus:
    """Entries sorted by norm, for exact searches of the nearest one."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order].astype(np.int64)

    def nearest(self, x: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each row of x, the lowest of several, and its squared distance."""
        n, k = len(x), len(self.norms)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        low = np.searchsorted(self.norms, norm)  # entries from low up to, not including, high are done
        high = low.copy()
        todo = np.arange(n)
        while len(todo):
            # A little wider than the interval itself, for the rounding of norms.
            reach = np.sqrt(best[todo].astype(np.float64)) * (1 + 1e-9) + 1e-6 * (1 + norm[todo])
            first = np.searchsorted(self.norms, norm[todo] - reach, "left")
            last = np.searchsorted(self.norms, norm[todo] + reach, "right")
            down, up = low[todo] - np.arange(1, step + 1)[:, None], high[todo] + np.arange(step)[:, None]
            for places, inside in ((down, down >= first), (up, up < last)):
                hop, row = np.nonzero(inside)
                self._try(x, todo[row], places[hop, row], best, at)
            low[todo], high[todo] = np.maximum(low[todo] - step, 0), np.minimum(high[todo] + step, k)
            todo = todo[(low[todo] > first) | (high[todo] < last)]
        return at, best

    def _try(self, x: np.ndarray, rows: np.ndarray, places: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        for a in range(0, len(rows), 1 << 16):
            r, p = rows[a : a + (1 << 16)], places[a : a + (1 << 16)]
            apart = x[r] - self.entries[p]
            far, entry = np.einsum("ij,ij->i", apart, apart), self.order[p]
            by = np.lexsort((entry, far, r))
            head = by[np.flatnonzero(np.diff(r[by], prepend=-1))]
            r, far, entry = r[head], far[head], entry[head]
            wins = (far < best[r]) | ((far == best[r]) & (entry < at[r]))
            best[r[wins]], at[r[wins]] = far[wins], entry[wins]


def _parts(column: pa.Array, books: list[np.ndarray]) -> list[np.ndarray]:
    width = books[0].shape[1]
    whole = matrix(column, width * len(books))
    return [whole[:, i * width : (i + 1) * width] for i in range(len(books))]


def refine(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: the codebooks after every part has gone to its nearest entry."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)  # parts * entries

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = sent.value
        rings, sums, counts = [Annulus(b) for b in old], [np.zeros_like(b) for b in old], [np.zeros(len(b), np.int64) for b in old]
        for batch in batches:
            for ring, x, s, c in zip(rings, _parts(batch.column("v"), old), sums, counts):
                entry = ring.nearest(x)[0]
                np.add.at(s, entry, x)
                c += np.bincount(entry, minlength=len(c))
        for part, (s, c) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(c)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part)), pa.array(used), pa.array(c[used]), pa.array(list(s[used]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    each = vectors.select("v").mapInArrow(total, "part long, entry long, n long, sums array<long>")
    found = each.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()
    after = [b.copy() for b in books]
    for part, book in enumerate(after):
        own = found[found["part"] == part]
        book[own["entry"], own["at"]] = own["s"].to_numpy() // own["n"].to_numpy()
    return after


def learn_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of vectors (vec_id, v), by part."""
    size = vectors.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return []
    seeds = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).toPandas()["v"]
    width = max(1, -(-size // parts))
    first = np.zeros((len(seeds), width * parts), np.int64)
    for row, v in zip(first, seeds):
        row[: len(v)] = v
    books = [first[:, i * width : (i + 1) * width].copy() for i in range(parts)]
    for _ in range(rounds):
        books = refine(vectors, books)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vectors (vec_id, label, v) -> vec_id, label, code and error."""
    kinds = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Annulus(b) for b in sent.value]
        for batch in batches:
            found = [ring.nearest(x) for ring, x in zip(rings, _parts(batch.column("v"), sent.value))]
            entries = np.stack([f[0] for f in found], 1).astype(np.uint8)
            codes = [row.tobytes().hex() for row in entries]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "v").mapInArrow(code, f"{', '.join(kinds)}, code string, error long")


def books_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(embeddings: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """embeddings (vec_id, label and a vector) -> vec_id, code, error, label_error, codebooks_sha256."""
    vectors = stash(integer_vectors(embeddings, column, scale, MOST).select("vec_id", "label", "v"), "vectors")
    books = learn_books(vectors)
    coded = stash(encode(vectors, books), "codes") if books else encode(vectors.limit(0), [np.zeros((1, 1), np.int64)])
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    steps = [
        """kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "cut as materialized (select vec_id, p, v[cast(p * len(v) / 4 as bigint) + 1 : cast((p + 1) * len(v) / 4 as bigint)] as x from kept, range(4) t(p))",
        "b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from cut qualify e < 256)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} as materialized (select vec_id, p, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := e)) as m
  from cut join b{r} using (p) group by vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""s{r} as materialized (select p, e, list(s order by i) as c from (select p, m.e as e, i, floor(sum(x[i]) / count(*)) as s from a{r} join cut using (vec_id, p), range(1, 1 + len(x)) t(i) group by all) group by p, e)""")
            steps.append(f"b{r + 1} as materialized (select p, e, coalesce(s{r}.c, b{r}.c) as c from b{r} left join s{r} using (p, e))")
    last = f"a{ROUNDS}"
    steps.append(f"coded as (select vec_id, label, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error from {last} join kept using (vec_id) group by vec_id, label)")
    steps.append(f"h as (select sha256(string_agg(cast(cast(c[i] as bigint) as varchar), ',' order by p, e, i)) as codebooks_sha256 from b{ROUNDS}, range(1, 1 + len(c)) t(i))")
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, h"


SQL = _sql()
