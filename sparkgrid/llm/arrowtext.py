"""Texts of Arrow batches as flat bytes, their words and word hashes, in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Slices of a batch hold about so many bytes of text (or one text, if longer).
SLICE_BYTES = 1 << 19


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of bounded text size, so memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(bounds(batch.column(column))[1]))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task and counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each text begins (nulls are empty)."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or begin[-1] == begin[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[begin[0] : begin[-1]], begin - begin[0]


def byte_table(members: bytes) -> np.ndarray:
    """True for the bytes given."""
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


#: Bytes of words that blanks separate, and A-Z made a-z.
NOT_BLANK = ~byte_table(bytes([0x20, *range(0x09, 0x0E)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all (splitmix64's constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_multipliers = np.zeros(0, U64)


def multipliers(n: int, seed: int = 0) -> np.ndarray:
    """n odd multipliers that depend on their position and the seed only."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def word_hashes(data: np.ndarray, begin: np.ndarray, member: np.ndarray = NOT_BLANK, prefixes: tuple[int, ...] | None = None) -> tuple:
    """64-bit hashes of the lower-cased words in order, and where each text's words begin.

    A word is a longest run of bytes in ``member``; a run ends with its text.
    With ``prefixes`` also, for each of these lengths, the hashes of the words'
    first bytes, 0 for words that are not longer.
    """
    global _multipliers
    texts = len(begin) - 1
    inside = member[data]
    if not inside.any():
        none = np.zeros(0, U64), np.zeros(texts + 1, np.int64)
        return none if prefixes is None else (*none, [none[0] for _ in prefixes])
    edge = np.zeros(len(data) + 1, bool)
    edge[begin] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sizes = ends - starts
    if len(_multipliers) < sizes.max():
        _multipliers = multipliers(max(64, int(sizes.max())))
    at = np.flatnonzero(inside)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    parts = (LOWER[data[at]].astype(U64) + U64(1)) * _multipliers[place]
    out = mix64(np.add.reduceat(parts, first) + sizes.astype(U64)), np.searchsorted(starts, begin)
    if prefixes is None:
        return out
    cut = []
    for length in prefixes:
        longer = np.flatnonzero(sizes > length)
        value = np.zeros(len(sizes), U64)
        total = np.full(len(longer), length << 40, U64)
        for j in range(length):
            total += parts[first[longer] + j]
        value[longer] = mix64(total) | U64(1)
        cut.append(value)
    return (*out, cut)


def shingle_hashes(words: np.ndarray, begin: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words.

    A text of fewer words, but not none, has one: all of them.
    """
    by = multipliers(k + 1, seed=77)
    runs = np.zeros(max(0, len(words) - k + 1), U64)
    for j in range(k):
        runs += words[j : len(words) - k + 1 + j] * by[j] if len(runs) else U64(0)
    runs = mix64(runs)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            one = np.array([b - a], U64) * by[k : k + 1] + (words[a:b] * by[: b - a]).sum(keepdims=True, dtype=U64)
            out.append(mix64(one))
        else:
            out.append(np.zeros(0, U64))
    return out
