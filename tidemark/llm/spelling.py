"""Spelling variant grouping: words that are one inserted, deleted or replaced letter apart.

Rare-first prefix filter over positional bigrams. All bigrams of the vocabulary are ordered by
frequency; each word is looked up by its three rarest only. One edit destroys two bigrams of a
word at most and keeps the others in order, so of two words that are one edit apart, one of the
three rarest of each is the same bigram at the same place, untouched by the edit: as many letters
from the start if the edit is behind it, or from the end if the edit is before it. That is the
limit on positions, and more: everything on the bigram's other side is equal too, and of the side
that has the edit, one half or the other. Words therefore meet by the hash of a bigram's place,
of the text up to it and of half the text beyond it (or the mirror image), in classes by the
length of the shorter word. Pairs that meet are compared by the sets of their letters, a bit for
the first and second of each, and then by edit distance.

The joins are by sorting: a table of words or keys takes little room on disk and much in memory, so by its
size on disk Spark would choose to gather it on the driver and send it.

Words are counted by text, then over all texts. The order of bigrams is a table of at most 90 * 90
rows, as words have no other letters, and goes to every task.

Defined results: a null text has no words; a null id stands as an empty text in the hash that
deletes a letter; repeated rows count each; near words of equal count are ordered by code point;
no documents give no rows; further columns stay out of the result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stash, stash
from . import textbatch as tb

SHORTEST, RAREST = 7, 3
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LEAD = 0xC3  # the first byte of every letter from U+00C0 to U+00FF, and of no other character


def _runs(t: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of letters of at least SHORTEST code points start and end, and the text of each."""
    lead = t.data == LEAD
    inside = LETTER[t.data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(inside) + 1, bool)
    edge[t.bounds] = True
    before = np.concatenate([[False], inside])[:-1] & ~edge[:-1]
    after = np.concatenate([inside, [False]])[1:] & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    long = end - start - (leads[end] - leads[start]) >= SHORTEST
    start, end = start[long], end[long]
    return start, end, np.searchsorted(t.bounds, start, "right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a few texts at a time, with letters deleted by the hash of id and word."""
    for batch, t in tb.pieces(batches, most=8 << 20):
        start, end, text = _runs(t)
        if not len(start):
            continue
        size = end - start
        bounds = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
        letters = tb.LOWER[t.data[place]]
        runs = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
        words, code = [w.encode() for w in runs.dictionary.to_pylist()], runs.indices.to_numpy()
        pair, n = np.unique(text * len(words) + code, return_counts=True)
        heads = [zlib.crc32(f"{x}:".encode()) for x in batch.column("id").to_pylist()]
        of, which = pair // len(words), pair % len(words)
        hashes = np.fromiter((zlib.crc32(words[w], heads[d]) for d, w in zip(of.tolist(), which.tolist())), np.int64, len(pair))
        hit = hashes % 31 == 0
        whole = np.bincount(which[~hit], n[~hit], len(words)).astype(np.int64)
        cut: Counter[str] = Counter()
        for w, h, c in zip(which[hit].tolist(), hashes[hit].tolist(), n[hit].tolist()):
            word = words[w].decode()
            at = h % len(word)
            if len(word) > SHORTEST:
                cut[word[:at] + word[at + 1 :]] += c
        kept = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([runs.dictionary.cast(pa.string()).take(pa.array(kept)), pa.array(whole[kept])], names=["word", "n"])
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array(list(cut), pa.string()), pa.array(list(cut.values()), pa.int64())], names=["word", "n"])


def count_words(documents: DataFrame, least: int = 2) -> DataFrame:
    """word and n: the words of documents (doc_id, text) that occur at least so often."""
    texts = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null")
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers and letters (a byte for each) of the words of each length."""
    latin = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.fromiter(map(len, latin), np.int64, len(latin))
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        yield own, np.frombuffer(b"".join(latin[i] for i in own), np.uint8).reshape(len(own), length)


def _bigrams(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1].astype(np.int64) * 256 + letters[:, 1:]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(65536, np.int64)
    for batch in batches:
        for _, letters in _by_length(batch.column("word")):
            total += np.bincount(_bigrams(letters).ravel(), minlength=65536)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def _letter_sets(letters: np.ndarray) -> np.ndarray:
    """A bit for the first of each letter in a word and another for its second; one edit changes two at most."""
    kind = np.where(letters < 128, letters & 31, 27 + letters % 5).astype(np.int64)
    out = np.zeros(len(letters), np.int64)
    for k in range(32):
        n = (kind == k).sum(1)
        out |= (n > 0).astype(np.int64) << np.int64(2 * k)
        out |= (n > 1).astype(np.int64) << np.int64(2 * k + 1)
    return out


def _meeting_keys(letters: np.ndarray, order: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and keys by which words of one length meet others of it, or (longer) those that have one letter less."""
    n, length = letters.shape
    shorter = length - longer
    grams = order[_bigrams(letters)] * (1 << 32) + np.arange(length - 1)
    at = np.argpartition(grams, RAREST - 1, axis=1)[:, :RAREST] if length - 1 > RAREST else np.broadcast_to(np.arange(length - 1), (n, length - 1))
    steps = np.multiply.accumulate(np.full(length + 1, 0x9E3779B97F4A7C15, np.uint64))

    def sums(x: np.ndarray) -> np.ndarray:
        """Of each number of first letters, a hash."""
        out = np.zeros((n, length + 1), np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * steps[:-1], axis=1, out=out[:, 1:])
        return out

    ahead, back = sums(letters), sums(letters[:, ::-1])
    row = np.broadcast_to(np.arange(n)[:, None], at.shape)
    for mirrored, near, far, place in ((0, ahead, back, at), (1, back, ahead, length - 2 - at)):
        rest = shorter - place - 2  # letters of the shorter word beyond the bigram
        r, p, half = row[rest >= 0], place[rest >= 0], rest[rest >= 0] // 2
        about = ((p.astype(np.uint64) * np.uint64(2) + np.uint64(mirrored)) << np.uint64(32)) + np.uint64(shorter)
        yield r, tb.mix(tb.mix(near[r, p + 2 + half]) + about * np.uint64(4))
        yield r, tb.mix(tb.mix(near[r, p + 2]) ^ tb.mix(far[r, half] + np.uint64(7)) + about * np.uint64(4) + np.uint64(1))


def _keyed(words: DataFrame, order: np.ndarray, both: bool) -> DataFrame:
    """words by the keys of their class; both also has each word as the longer one of the class below."""
    sent = words.sparkSession.sparkContext.broadcast(order)  # 65,536 numbers

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, letters in _by_length(batch.column("word")):
                signs = _letter_sets(letters)
                for longer in (False, True) if both else (False,):
                    for row, key in _meeting_keys(letters, sent.value, longer):
                        columns = [pa.array(key.view(np.int64)), batch.column("word").take(pa.array(own[row])), pa.array(signs[row]), pa.array(np.full(len(row), longer))]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "letters", "longer"])

    return words.select("word").mapInArrow(emit, "key long, word string, letters long, longer boolean")


def near_words(words: DataFrame) -> DataFrame:
    """a and b: the pairs of different words (word) that are one edit apart, each once."""
    order = np.zeros(65536, np.int64)
    seen = words.select("word").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").toPandas()  # 90 * 90 at most
    order[seen["gram"]] = np.arange(len(seen))
    a = _keyed(words, order, False).select("key", F.col("word").alias("a"), F.col("letters").alias("x"))
    b = _keyed(words, order, True).select("key", F.col("word").alias("b"), F.col("letters").alias("y"), "longer")
    met = a.join(b.hint("merge"), "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """words (word, n) -> word, form, root, n, n_near, form_n.

    form: the near word of largest n if that is at least `times` the word's own; root: the end of
    the forms that follow one another from a word. As n grows along them, they are short.
    """
    pairs = stash(near_words(words), "near-words")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    best = both.join(counts.hint("merge"), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    known = words.join(best.hint("merge"), "word", "left").withColumn("form_n", F.when(-F.col("best.col1") >= times * F.col("n"), -F.col("best.col1")))
    known = stash(known.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"), "forms")
    drop_stash(pairs)
    roots = stash(known.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles how far a word sees
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stash(roots.join(further.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        drop_stash(roots)
        roots = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return known.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    words = stash(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words")
    return group_variants(words)


def _sql() -> str:
    crc = []
    for i in range(256):  # the table of crc32
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        crc.append(i)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # levenshtein() counts bytes there, so each letter of two bytes becomes one that words don't have.
    wide, narrow = "".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(33, 127)) if c not in lower + "'")[:64]

    def single(word: str) -> str:
        return f"translate({word}, '{wide}', '{narrow}')"

    return f"""with recursive runs as materialized (select coalesce(cast(doc_id as varchar), '') as id, word, count(*) as n from
  (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{upper}', '{lower}') as word from documents) where length(word) >= 7 group by all),
 bytes as (select *, list_transform(range(1, 1 + cast(octet_length(encode(id || ':' || word)) as bigint)), lambda i: cast(('0x' || substr(hex(encode(id || ':' || word)), 2 * i - 1, 2)) as bigint)) as b from runs),
 hashed as materialized (select word, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor({crc}[xor(c, x) % 256 + 1], c // 256)), 4294967295) as h from bytes),
 cut as (select n, case when h % 31 = 0 then word[1 : h % length(word)] || word[h % length(word) + 2 :] else word end as word from hashed),
 words as materialized (select word, cast(sum(n) as bigint) as n from cut where length(word) >= 7 group by word having sum(n) >= 2),
 keys as materialized (select word, n, word as k from words union select word, n, word[1 : i - 1] || word[i + 1 :] from words, range(1, 1 + length(word)) t(i)),
 near as materialized (select distinct a.word as word, a.n as n, b.word as near, b.n as near_n from keys a join keys b on a.k = b.k and a.word <> b.word where levenshtein({single('a.word')}, {single('b.word')}) = 1),
 best as (select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from near group by word),
 forms as materialized (select w.word, case when near_n >= 10 * w.n then near end as form, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * w.n then near_n end as form_n from words w left join best using (word)),
 walk as (select word, word as root from forms union select w.word, f.form from walk w join forms f on f.word = w.root where f.form is not null),
 ends as (select w.word, w.root from walk w join forms f on f.word = w.root where f.form is null)
 select word, form, root, n, n_near, form_n from forms join ends using (word)"""


SQL = _sql()
