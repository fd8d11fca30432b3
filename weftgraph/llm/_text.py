"""Vectorised splitting and hashing of UTF-8 texts, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; the temporary arrays take about fifty times as much.
SLICE_BYTES = 512 << 10

_rng = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A value for each byte, the same for A-Z and a-z.
_FOLDED = _BYTE[_LOWER]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a word: anything but ASCII white space.
WORD = ~_space
#: Bytes of a token: ASCII letters and digits, and all bytes of other characters.
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE_BYTES + 4096), _BASE if kind == "up" else _INVERSE)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def text_slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of up to limit bytes, or one longer row. Null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    if not len(array):
        return
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(array):
        hi = min(len(array), max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span, which depends on nothing outside of the span."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * _power("up", n), out=prefix[1:])
    out = (prefix[ends] - prefix[starts]) * _power("down", n + 1)[starts]
    return mix(out + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row (one more entry than rows). Words end with their row."""
    member = inside[data]
    before, after = np.empty_like(member), np.empty_like(member)
    if len(member):
        before[0], before[1:] = False, member[:-1]
        after[-1], after[:-1] = False, member[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < len(data)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words in each row (a shorter row counts as one run), and the number of the first run of each row."""
    count = np.diff(first)
    total = len(hashes)
    rolled = np.zeros(max(0, total - width + 1), np.uint64)
    for j in range(width):
        rolled += hashes[j : j + len(rolled)] * _STEP[j]
    runs = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(begin[-1]), np.uint64)
    if len(out):
        row = np.repeat(np.arange(len(count)), runs)
        at = np.arange(len(out)) - begin[row] + first[row]
        full = count[row] >= width
        out[full] = rolled[at[full]] + np.uint64(width)
        for i in np.flatnonzero(~full):
            k = int(count[row[i]])
            own = hashes[first[row[i]] : first[row[i]] + k]
            out[i] = (own * _STEP[:k]).sum(dtype=np.uint64) + np.uint64(k)
    return mix(out), begin


def distinct_by_row(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    values = values.copy()
    for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if e - s > 1:
            values[s:e].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    inner = begin[:-1]
    keep[inner[inner < len(values)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], kept[begin]
