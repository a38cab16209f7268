"""Vectorised work on the bytes of an Arrow text column: words, hashes and windows without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

CHUNK = 1 << 20
#: Strings above this many bytes are hashed one by one.
LONG = 256
_KEY = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as one number; beyond the end are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def slice_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``data``, the same wherever the bytes stand.

    Eight bytes at a time go through a finaliser, so that no relation between strings outlives a step (sums of
    powers modulo 2**64 have equal values for simple families of strings); strings above LONG go through xxh3.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * _KEY + _STEP)
    eight = eights(data)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, h = start[live], size[live], out[live]
    while len(live):
        h = mix((h ^ (eight[at] & _LOW[np.minimum(left, 8)])) * _STEP)
        out[live] = h
        more = left > 8
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null rows are empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``limit`` bytes, a row at least."""
    data, offsets = buffers(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def stretches(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets) of stretches that end at a separator: a very long row is worked on in parts.

    The rows keep their numbers; those outside a stretch are empty in it."""
    a = 0
    while a < len(data):
        b = min(a + limit, len(data))
        if b < len(data):
            back = np.flatnonzero(separators[data[a:b]])
            if len(back):
                b = a + int(back[-1]) + 1
            else:
                ahead = b
                while ahead < len(data) and not separators[data[ahead : ahead + limit]].any():
                    ahead += limit
                b = len(data) if ahead >= len(data) else ahead + int(np.argmax(separators[data[ahead : ahead + limit]]))
        yield a, data[a:b], np.clip(offsets, a, b) - a
        a = b


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, *cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes that do not separate; runs end with their row.

    With two more byte classes, a run is also cut where a byte of one meets a byte of the other."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    if cut:
        x, y = cut[0][data], cut[1][data]
        meet = (x[:-1] & y[1:]) | (y[:-1] & x[1:])
        begins[1:] |= meet
        ends[:-1] |= meet
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, *cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of each word, ASCII letters in lower case."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, part, bounds in stretches(data, offsets, separators, 2 * CHUNK):
        start, end, row = words(part, bounds, separators, *cut)
        hashes.append(slice_hash(FOLD[part], start, end))
        rows.append(row)
    return np.concatenate(hashes), np.concatenate(rows)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... for each run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
