"""Word shingles of whole Arrow batches in numpy, for functions that run inside Spark tasks.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's hash comes
from running sums over the bytes of a piece, so its cost does not depend on the number of words.
Texts are taken in pieces of at most PIECE bytes (longer only where a single word is), so the
memory beside the input is bounded by the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def _tables():
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(1, 257, dtype=np.uint64)
    lower[ord("A") + np.arange(26)] = ord("a") + 1 + np.arange(26, dtype=np.uint64)
    return space, lower


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & MASK, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hasher():
    """A function (bytes, row offsets) -> (hash of every word, words before each row)."""
    space, lower = _tables()
    held = {}

    def powers(n: int):
        if len(held.get("p", ())) < n:
            size = max(n, PIECE + (1 << 12))
            held["p"] = _powers(BASE, size)
            held["i"] = _powers(pow(BASE, -1, 1 << 64), size)
        return held["p"], held["i"]

    def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, places = [], []
        at, end = int(offsets[0]), int(offsets[-1])
        while at < end:
            stop = min(end, at + PIECE)
            while stop < end:  # up to the next space
                breaks = np.flatnonzero(space[data[stop : min(end, stop + 4096)]])
                if len(breaks):
                    stop += int(breaks[0])
                    break
                stop = min(end, stop + 4096)
            piece = data[at:stop]
            gap = space[piece]
            fresh = np.zeros(len(piece) + 1, bool)  # a row begins here
            inside = offsets[(offsets >= at) & (offsets <= stop)] - at
            fresh[inside] = True
            fresh[0] = fresh[-1] = True
            before, after = np.append(True, gap[:-1]), np.append(gap[1:], True)
            first = np.flatnonzero(~gap & (before | fresh[:-1]))
            last = np.flatnonzero(~gap & (after | fresh[1:])) + 1
            power, inverse = powers(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(lower[piece] * power[: len(piece)], out=total[1:])
            found.append(mixed((total[last] - total[first]) * inverse[first]))
            places.append(first + at)
            at = stop
        if not found:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)

    return hashes


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def shingle_sets(width: int):
    """A function from a text column to one sorted array of distinct shingle hashes per row.

    A text with fewer than ``width`` words has one shingle of all its words; without words none.
    """
    hashes = word_hasher()
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def sets(column: pa.Array):
        data, offsets = text_buffer(column)
        words, starts = hashes(data, offsets)
        n = max(0, len(words) - width + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(width):
            runs += words[k : k + n] * factors[k]
        runs = mixed(runs)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                few = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mixed(np.array([few], np.uint64))
            else:
                yield np.zeros(0, np.uint64)

    return sets
