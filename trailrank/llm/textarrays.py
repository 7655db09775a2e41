"""Texts as numpy arrays: slices of bounded size, words, hashes of ranges, classes of characters."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text worked on at once; a longer text is a slice of its own
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of the splitmix64 finalizer


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finalizer (splitmix64) of unsigned integers, different for each seed."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Slice:
    """Consecutive rows of a batch: their texts as one byte array, text i in offsets[i]:offsets[i+1]."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.data, self.offsets = first, last, data, offsets


def slices(column: pa.Array, limit: int = SLICE, rows: int | None = None) -> Iterator[Slice]:
    """Cut a text column into slices of about ``limit`` bytes, and of ``rows`` texts at most; null texts are empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n if rows is None else first + rows, n)
        yield Slice(first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


def words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, never across texts: starts, ends, and for each
    text the number of its first word (one more entry than texts)."""
    data = part.data
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(part.offsets), np.int64)
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    begins = np.zeros(n, bool)
    begins[part.offsets[:-1][part.offsets[:-1] < n]] = True
    starts = np.flatnonzero(inside & (begins | ~np.concatenate(([False], inside[:-1]))))
    last = np.concatenate((begins[1:], [True]))
    ends = np.flatnonzero(inside & (last | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, part.offsets)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_STEP = 1 << 16  # powers are made for so many places at a time; a worker keeps them, for every seed it has met


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i up to n (odd bases have an inverse)."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < n + 1:
        size = -(-(n + 1) // _STEP) * _STEP
        base = (int(mix(np.array([seed], np.uint64), 77)[0]) | 7) & 0xFFFFFFFFFFFFFFFF
        def row(b):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64, out=out)
        _POWERS[seed] = row(base), row(pow(base, -1, 1 << 64))
    return _POWERS[seed]


def give_back() -> None:
    """A Python worker goes on to other tasks, of other stages too: what one task's arrays have left there, tables of powers and
    memory that is free but still held, goes back to the system."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for each range, from one pass of prefix sums."""
    n = len(values)
    up, down = _powers(seed, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values, seed + 100) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), seed)


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """As range_hash, for bytes."""
    n = len(data)
    up, down = _powers(seed, n)
    table = mix(np.arange(256, dtype=np.uint64), seed + 100)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), seed)


OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    if not _CLASSES:
        import regex
        table = np.zeros(0x110000, np.uint8)
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            text = "".join(map(chr, range(low, high)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(pattern, text):
                    table[low + m.start():low + m.end()] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def code_points(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a slice and, for each text, the place of its first one (one more entry
    than texts)."""
    n = len(part.data)
    points = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == n:
        return points, part.offsets
    return points, part.offsets - np.searchsorted(np.flatnonzero((part.data & 0xC0) == 0x80), part.offsets)
