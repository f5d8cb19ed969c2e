"""Vectorised word splitting and hashing straight from Arrow string buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of words [^\x20\x09-\x0D]+, and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after folding A-Z).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
LINE = np.ones(256, bool)
LINE[0x0A] = False
#: A-Z to a-z, the rest as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

PIECE = 1 << 20  # bytes hashed at once; a longer text is cut at separators
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text; a longer text comes alone."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes; a run ends where its text does."""
    m = inside[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    some = at[1:] > at[:-1]
    lo, hi = at[:-1][some], at[1:][some] - 1
    first[lo] = m[lo]
    last[hi] = m[hi]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _blocks(padded: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as an integer, those beyond the span's end as zeros."""
    every = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    return every[at] & _KEEP[np.minimum(ends - at, 8)]


def _expanded(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The second and later eight-byte blocks of spans of more than eight bytes: their span, their number and their place, PIECE / 4 at a time."""
    far = np.flatnonzero(ends - starts > 8)
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum((ends[far] - starts[far] - 1) >> 3)])
    step = max(1, PIECE >> 2)
    for lo in range(0, int(to[-1]), step):
        hi = min(lo + step, int(to[-1]))
        i, j = int(np.searchsorted(to, lo, side="right")) - 1, int(np.searchsorted(to, hi, side="left"))
        which = np.repeat(np.arange(i, j), np.minimum(to[i + 1 : j + 1], hi) - np.maximum(to[i:j], lo))
        number = np.arange(lo, hi) - to[which] + 1
        yield far[which], number, starts[far[which]] + 8 * number


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte runs: every block of eight bytes is mixed with its number before the blocks are added up, so that no
    rearrangement of blocks or bytes cancels out as it would in a polynomial. Other seeds give independent hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded, key = np.concatenate([data, np.zeros(8, np.uint8)]), np.uint64(mix(np.array([seed], np.uint64))[0])
    h = mix(_blocks(padded, starts, ends) + key)
    for span, number, at in _expanded(starts, ends):
        x = mix(_blocks(padded, at, ends[span]) ^ mix(number.astype(np.uint64) + key))
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), span[1:] != span[:-1]]))
        h[span[first]] += np.add.reduceat(x, first)
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the very bytes of span number other[i]."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = ends - starts
    same = (n == n[other]) & (_blocks(padded, starts, ends) == _blocks(padded, starts[other], ends[other]))
    for span, number, at in _expanded(np.where(same, starts, ends), ends):
        twin = other[span]
        there = np.minimum(starts[twin] + 8 * number, ends[twin])
        np.logical_and.at(same, span, _blocks(padded, at, ends[span]) == _blocks(padded, there, ends[twin]))
    return same


def exact_codes(h: np.ndarray, equal, key) -> np.ndarray:
    """Numbers of the items such that equal numbers mean equal items: by hash h, each item held against the first one of its hash.

    equal(items) says whether items[0] and items[1] are the same, pair by pair; key(i) is item i as a value, for hashes that differ in
    meaning though not in value (then all items are numbered by value).
    """
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    if len(h) and not equal(np.arange(len(h)), first[code]).all():
        seen: dict = {}
        code = np.array([seen.setdefault(key(i), len(seen)) for i in range(len(h))])
    return code


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the words, equal for words of the same bytes only."""
    return exact_codes(h, lambda i, j: equal_spans(data, starts, ends, j), lambda i: data[starts[i] : ends[i]].tobytes())


def window_codes(codes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows of k items (a shorter text is one), equal for windows of the same items only, and each text's first."""
    h, first, to = windows(codes.astype(np.uint64), at, k)
    size = np.minimum(np.repeat(np.diff(at), np.diff(to)), k)
    end = max(len(codes) - 1, 0)

    def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = size[i] == size[j]
        for x in range(k):
            same &= (x >= size[i]) | (codes[np.minimum(first[i] + x, end)] == codes[np.minimum(first[j] + x, end)])
        return same

    return exact_codes(h, equal, lambda i: tuple(codes[first[i] : first[i] + size[i]].tolist())), to


def _pieces(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes; the cuts lie at ends of texts or at separators."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + PIECE
        if hi >= n:
            yield lo, n
            return
        k = int(np.searchsorted(at, hi, side="right")) - 1
        if at[k] > lo:
            hi = int(at[k])
        else:  # one long text: its next separator
            end, step = int(at[k + 1]), 1 << 16
            while hi < end:
                gap = np.flatnonzero(~inside[data[hi : min(end, hi + step)]])
                if len(gap):
                    hi += int(gap[0])
                    break
                hi = min(end, hi + step)
        yield lo, hi
        lo = hi


def hashed(data: np.ndarray, at: np.ndarray, inside: np.ndarray = SPACED, fold: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the runs of all texts, and the first run of each text (one more at the end)."""
    if fold:
        data = FOLD[data]
    found = []
    for lo, hi in _pieces(data, at, inside):
        i, j = np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi, side="left")
        own = np.clip(at[i : j + 1], lo, hi) - lo
        part = data[lo:hi]
        s, e = spans(part, own, inside)
        found.append((hash_spans(part, s, e, seed), s + lo, e + lo))
    h, s, e = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return h, s, e, np.searchsorted(s, at)


def per_text(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a per-item array over each text's items at[i]:at[i+1]."""
    if counts.dtype.kind == "f":  # prefix sums would lose digits
        out, some = np.zeros(len(at) - 1), at[1:] > at[:-1]
        if some.any():
            out[some] = np.add.reduceat(counts[: at[-1]], at[:-1][some])
        return out
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each one, memory that is free goes back to the system, as workers wait for their next task with all they hold."""
    pool, trim = pa.default_memory_pool(), getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()
        if trim is not None:
            trim(0)


def owners(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def windows(h: np.ndarray, at: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of k items, their first items, and each text's first window; whole: a shorter text is one window."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0) & whole).astype(np.int64)
    to = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(to[-1]) - np.repeat(to[:-1] - at[:-1], count)
    short = np.repeat(n, count)
    out = np.zeros(len(first), np.uint64)
    for i in range(k):
        live = i < short
        item = h[np.minimum(first + i, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(live, mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + item), out)
    return out, first, to
