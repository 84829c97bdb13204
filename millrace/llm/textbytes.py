"""Vectorised scans over the UTF-8 bytes of whole Arrow batches of texts.

Every function works on the flat byte buffer of a batch, so the cost per text
is a few numpy passes and never a Python step per word.  A null text counts
as an empty one.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that go through a function at once; one longer text goes alone.
SLICE_BYTES = 1 << 20
#: Bytes that one numpy pass widens to words of 8 bytes; longer texts are cut inside.
STEP_BYTES = 1 << 18

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets has one entry more than texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about SLICE_BYTES each; every row comes once."""
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, a function over a task's batches, after which the worker gives back its memory: it lives on and would hold it while other steps need theirs."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased and nothing else changed."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def is_space(data: np.ndarray) -> np.ndarray:
    """True for the bytes 0x20 and 0x09-0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def _steps(data: np.ndarray) -> list[int]:
    """Places that cut data into steps of about STEP_BYTES, never inside a word."""
    ends = [0]
    while len(data) - ends[-1] > STEP_BYTES:
        at = ends[-1] + STEP_BYTES
        while at < len(data):
            blanks = np.flatnonzero(is_space(data[at : at + STEP_BYTES]))
            if len(blanks):
                at += int(blanks[0])
                break
            at += STEP_BYTES
        ends.append(min(at, len(data)))
    return ends if ends[-1] == len(data) else [*ends, len(data)]


def _hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places of first bytes) of the words of one step; words also end at bounds."""
    n = len(data)
    word = ~is_space(data)
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[bounds] = word[bounds]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    place = np.where(word, np.arange(n) - begin, 0)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
        value = np.where(word, _BYTE[data] * power[place], np.uint64(0))
        return mix64(np.add.reduceat(value, starts)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text the index of its first word (one entry more)."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    ends = _steps(data)
    for a, b in zip(ends, ends[1:], strict=False):
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b)]
        h, at = _hash_words(data[a:b], inner - a)
        hashes.append(h)
        starts.append(at + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of all texts, and each text's first shingle (one entry more).

    A text with fewer than n words, but at least one, has its whole sequence
    as its only shingle; a text without words has none.
    """
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    total = int(at[-1])
    if not total:
        return np.zeros(0, np.uint64), at
    text = np.repeat(np.arange(len(counts)), made)
    start = first[:-1][text] + np.arange(total) - at[:-1][text]
    have = np.minimum(counts[text], n)
    out = mix64(have.astype(np.uint64) + np.uint64(0x51ED27))
    with np.errstate(over="ignore"):
        for k in range(n):
            on = have > k
            h = words[np.where(on, start + k, 0)]
            out = np.where(on, mix64(out * np.uint64(0xD6E8FEB86659FD93) + h), out)
    return out, at


def distinct_sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and each text's first (one entry more)."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    if len(v):
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    return v, np.searchsorted(o, np.arange(len(at)))


def segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for every i; empty segments give zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0, dtype=values.dtype)])
    return total[at[1:]] - total[at[:-1]]


def _gram_buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Buckets (below 2**bits) of the n bytes at every place that has so many after it."""
    size = len(data) - n + 1
    h = np.full(max(size, 0), np.uint32(2166136261 ^ n), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n if size > 0 else 0):
            h = (h ^ data[k : k + size]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
    return (h & np.uint32((1 << bits) - 1)).astype(np.int64)


def byte_ngrams(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-byte grams inside each text, and each text's first gram (one entry more)."""
    made = np.maximum(np.diff(offsets) - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(made)])
    start = np.repeat(offsets[:-1] - at[:-1], made) + np.arange(int(at[-1]))
    return _gram_buckets(data, n, bits)[start] if len(start) else np.zeros(0, np.int64), at


def gram_sums(data: np.ndarray, offsets: np.ndarray, n: int, bits: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of each text's weight rows over its n-byte grams, number of its grams).

    weights are whole numbers, 2**bits rows of them, so a sum does not depend on
    where a text stands.  Texts are read in steps, long ones cut inside, and one
    column at a time: memory grows with the step, not with the text.
    """
    out = np.zeros((len(offsets) - 1, weights.shape[1]), np.int64)
    columns = [np.append(w, 0).astype(np.int64) for w in weights.T]
    for a in range(0, len(data) - n + 1, STEP_BYTES):
        b = min(a + STEP_BYTES, len(data) - n + 1)
        bucket = _gram_buckets(data[a : b + n - 1], n, bits)
        # grams that would run over a text's end count as the last, empty row
        ends = offsets[1:][(offsets[1:] > a) & (offsets[1:] < b + n - 1)] - a
        for k in range(1, n):
            over = ends - k
            bucket[over[(over >= 0) & (over < b - a)]] = 1 << bits
        # texts with bytes in the step
        low = int(np.searchsorted(offsets, a, "right")) - 1
        high = int(np.searchsorted(offsets, b))
        own = low + np.flatnonzero(np.diff(offsets[low : high + 1]))
        begin = np.maximum(offsets[own] - a, 0)
        for j, column in enumerate(columns):
            out[own, j] += np.add.reduceat(column[bucket], begin)
    return out, np.maximum(np.diff(offsets) - n + 1, 0)
