"""Words, lines and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

Used inside Arrow tasks. A word is a longest run of bytes outside space and \\t to \\r. Words
and shingles are known by 64-bit hashes: two different ones share a hash with a chance of
2**-64, which at 10**10 different shingles means a few pairs in the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_OF_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over all 64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Texts(NamedTuple):
    data: np.ndarray  # the bytes of all texts, one after another
    bounds: np.ndarray  # where each text starts, and the end of the last


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # the number of each word's text
    first: np.ndarray  # the number of each text's first word, and the number of all words


def texts_of(column: pa.Array) -> Texts:
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return Texts(data, bounds - bounds[0])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cuts batches so that each piece has about `most` bytes of text, or one longer text."""
    for batch in batches:
        at, n = 0, batch.num_rows
        bounds = texts_of(batch.column(text)).bounds
        while at < n:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            piece = batch.slice(at, end - at)
            yield piece, texts_of(piece.column(text))
            at = end


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags each text (or other run) has."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def words_of(t: Texts) -> Words:
    inside = ~SPACE[t.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[t.bounds] = True
    before = np.concatenate([[False], inside])[:-1] & ~edge[:-1]
    after = np.concatenate([inside, [False]])[1:] & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(t.bounds, start, "right") - 1
    first = np.searchsorted(start, t.bounds)
    return Words(start, end, text, first)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; runs don't overlap and are in order."""
    size = end - start
    out = mix(size.astype(U))
    full = size > 0
    size, start = size[full], start[full]
    if not len(size):
        return out
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    powers = np.full(int(size.max()) + 1, _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = _OF_BYTE[data[place + np.repeat(start, size)]] * powers[place]
    out[full] ^= mix(np.add.reduceat(terms, at[:-1]))
    return mix(out)


def windows(hashes: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, and the number of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    ok = np.flatnonzero(words.text[:n] == words.text[k - 1 :])
    total = np.zeros(len(ok), U)
    for j in range(k):
        total += hashes[ok + j] * _STEPS[j]
    return mix(total), ok


def shingles(hashes: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text, and where each text's begin.

    A text with fewer than k words, but one at least, has its whole sequence as one shingle.
    """
    h, at = windows(hashes, words, k)
    text = words.text[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.array([mix(np.add.reduce(hashes[a:b] * _STEPS[: b - a], keepdims=True) ^ U(b - a))[0] for a, b in zip(words.first[short], words.first[short + 1])], U)
        h, text = np.concatenate([h, own]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    bounds = np.searchsorted(text, np.arange(len(count) + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]
