"""Words of whole texts as numpy arrays over the Arrow buffers, without a Python object for each word.

A word is a run of bytes other than blanks (0x20, 0x09-0x0D). UTF-8 never uses those bytes inside a character, so this
equals splitting the text at these characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes; arrays of that many 8-byte numbers stay in the processor's caches.
CHUNK_BYTES = 1 << 19

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply, in place on a copy)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, as long as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self.up[:n], self.down[:n]


_BYTES_KEPT = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_PLACE, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


@dataclass
class Words:
    """Words of rows lo to hi of a column. first[i] is the first word of row lo + i, first[-1] the number of words."""

    lo: int
    hi: int
    bytes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Of each word, the row less lo."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty."""
    if not pa.types.is_large_string(values.type):
        values = values.cast(pa.large_string())
    if values.null_count:
        values = values.fill_null("")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(values: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a string column, in chunks of rows. lower folds A-Z."""
    data, offsets = column(values)
    for lo, hi in chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        part = _LOWER[part] if lower else part
        bounds = offsets[lo : hi + 1] - offsets[lo]
        inside = np.ones(len(part) + 1, dtype=bool)
        inside[:-1] = ~_BLANK[part]
        inside[-1] = False
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = bounds[:-1]
        cuts = cuts[cuts < len(part)]
        begins[cuts] = inside[cuts]
        ends = inside[:-1] & ~inside[1:]
        last = bounds[1:][np.diff(bounds) > 0] - 1
        ends[last] = inside[last]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Words(lo, hi, part, start, end, np.searchsorted(start, bounds).astype(np.int64))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes: the sum of its 8-byte pieces, each spread together with its place, and the length.

    No two words of at most 8 bytes share one. The spreading isn't linear, so words built from equal pieces in other
    orders (which collide under any polynomial modulo 2**64) differ like any others.
    """
    if not len(w):
        return np.zeros(0, dtype=np.uint64)
    size = w.end - w.start
    padded = np.concatenate([w.bytes, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(w.bytes) + 1, dtype="<u8", buffer=padded, strides=(1,))
    total = mix((eight[w.start] & _BYTES_KEPT[np.minimum(size, 8)]) + _PLACE)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        first = np.cumsum(more) - more
        place = np.arange(first[-1] + more[-1]) - np.repeat(first, more) + 1
        begin = np.repeat(w.start[long], more) + 8 * place
        kept = _BYTES_KEPT[np.minimum(np.repeat(w.end[long], more) - begin, 8)]
        spread = mix((eight[begin] & kept) + mix((place.astype(np.uint64) + np.uint64(1)) * _PLACE))
        total[long] += np.add.reduceat(spread, first)
    return mix(total ^ (size.astype(np.uint64) * _SIZE))


def runs_of(hashes: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """Hashes of every n consecutive numbers, across documents too: take those that lie within one."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64, out=total[1:])
    return mix((total[n:] - total[:-n]) * down[:m])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive numbers, by doubling."""
    if len(x) < n:
        return x[:0]
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = n - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pack(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array: value i holds the bytes of values[bounds[i]:bounds[i + 1]]."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, dtype=np.int64) * values.dtype.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def unpack(values: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary array, and the bounds of each value's numbers."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    size = np.dtype(dtype).itemsize
    data = values.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype=dtype), (offsets - offsets[0]) // size
