"""Texts as ragged byte arrays: word borders, word hashes and byte-bounded slices, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SLICE_BYTES

ODD = 0x9E3779B97F4A7C15
BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def byte_class(inside: str) -> np.ndarray:
    """256 flags: True for bytes that belong to words. 'space': all but \\x20 and \\x09-\\x0D. 'alnum': a-z, 0-9 and bytes above \\x7F (after lower-casing A-Z)."""
    flags = np.ones(256, bool)
    if inside == "space":
        flags[[0x20, *range(0x09, 0x0E)]] = False
    else:
        flags[:0x80] = False
        flags[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B)]] = True
    return flags


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def borders(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words of all texts; first[i]: number of words before text i. No word spans two texts."""
    word = flags[data]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start = word.copy()
    start[1:] &= ~word[:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] = word[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    stop[tails] = word[tails]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers["up"]) < n:
        for key, base in (("up", BASE), ("down", BASE_INV)):
            out = np.empty(n, np.uint64)
            out[0] = 1
            have = 1
            while have < n:
                step = min(have, n - have)
                out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
                have += step
            _powers[key] = out
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads low bits upward and high bits downward."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(ODD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of each span's units (a polynomial from prefix sums), block by block of bounded size."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + limit, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return base + np.arange(total)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label
