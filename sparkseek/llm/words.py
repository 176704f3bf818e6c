"""Words, word hashes and shingles of whole texts, for a whole Arrow column at a time.

A word is a run of bytes other than the blank and the control characters 9 to 13; only the letters
A-Z are lowered. A word's hash is a polynomial over random byte values modulo 2**64, so that the
hashes of all words of a column come from one running sum. Two different words or shingles share a
hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; bounds a task's memory. A longer text is taken alone.
PIECE_BYTES = 512 << 10

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0x2545F4914F6CDD1D
PLACES = mix(np.arange(1000, 1064, dtype=U64)) | U64(1)

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[begins[0] : begins[-1]], begins - begins[0]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of text."""
    _, begins = flat(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(begins, begins[first] + size, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each span of bytes, the same for the same bytes anywhere."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word of each text (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(BLANK[data], out=inside[1:-1])
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, begins)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; of the whole sequence if it is shorter, of none if empty."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, k)
    total = np.full(n - k + 1, PLACES[63 - k], U64)
    for place in range(k):
        total += words[place : n - k + 1 + place] * PLACES[place]
    return mix(total)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text."""
    data, begins = flat(texts)
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, begins)
    words = span_hashes(data, starts, ends)
    shingles = shingle_hashes(words, k)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= k:
            yield np.unique(shingles[a : b - k + 1])
        else:
            yield shingle_hashes(words[a:b], k)
