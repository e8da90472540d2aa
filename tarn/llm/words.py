"""Vectorised word handling over Arrow text columns.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(``[^\\x20\\x09-\\x0D]+``). Everything here works on the UTF-8 buffer of an Arrow
column, a slice of a few MB at a time, so that memory in a Python worker is
bounded by the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: By number of bytes: the bits of a little-endian 64-bit number that they take up.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd(k: np.ndarray) -> np.ndarray:
    """An odd multiplier for each place."""
    return mix(k.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; equal bytes give equal hashes in any slice.

    Each eight bytes are mixed by themselves before they are summed with a multiplier for their place, so no
    pattern of bytes makes two texts alike for every choice of constants.
    """
    padded = np.concatenate([np.ascontiguousarray(data), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    sizes = (ends - starts).astype(np.int64)
    total = mix(eight[starts] & _MASKS[np.minimum(sizes, 8)])
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) >> 3  # parts after the first
        first = np.cumsum(more) - more
        k = np.arange(more.sum()) - np.repeat(first, more) + 1
        at = np.repeat(starts[long], more) + 8 * k
        parts = mix(eight[at] & _MASKS[np.minimum(np.repeat(ends[long], more) - at, 8)]) * _odd(k)
        total[long] += np.add.reduceat(parts, first)
    return mix(total + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Slice:
    """Some consecutive rows of a column: their bytes end to end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and row of each word."""
        inside = ~_SPACE[self.data]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        before[cuts] = False
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        after[cuts - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string or binary column into slices of about size bytes; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each word; the last n - 1 are meaningless."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(min(n, len(hashes))):
        out[: len(hashes) - k] = mix(out[: len(hashes) - k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:])
    return out


def starts_of_rows(rows: np.ndarray, n: int) -> np.ndarray:
    """Given the sorted row of each item: where the items of each of the n rows begin (n + 1 values)."""
    return np.searchsorted(rows, np.arange(n + 1))
