"""Texts of an Arrow batch as one byte array: words, hashes and sums per text in numpy.

Work is done per block of whole texts of about ``BLOCK_BYTES`` bytes, which stay in a core's
cache; a single longer text is a block of its own, whose costly parts are done piece by piece
(``word_hashes``, ``parts``). So memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive whole texts; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + block_bytes, side="right")) - 1)
        yield first, data[off[first]:off[last]], off[first:last + 1] - off[first]
        first = last


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one for each byte) over each text."""
    if len(offsets) == 2:
        return np.array([np.count_nonzero(values) if values.dtype == bool else values.sum()], dtype=np.int64)
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that holds each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes, cut at the ends of texts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space)."""
    return spans(~_SPACE[data], offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Hasher:
    """Hashes of any byte spans of one block, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_MULT, n), out=self.sums[1:])
        self.inverse = _powers(_INV, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, taken over parts of about ``BLOCK_BYTES`` bytes of whole words."""
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        base = starts[i]
        out[i:j] = Hasher(data[base:ends[j - 1]])(starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A block as it is, or one long text in parts that are cut at a white-space byte, which ends one and begins the next."""
    if len(offsets) != 2 or len(data) <= 2 * BLOCK_BYTES:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end, width = len(data), BLOCK_BYTES
        while at + width < len(data):
            white = np.flatnonzero(_SPACE[data[at + width // 2:at + width]])
            if len(white):
                end = at + width // 2 + int(white[-1]) + 1
                break
            width *= 2
        yield data[at:end], np.array([0, end - at])
        at = end if end == len(data) else end - 1


def windows(values: np.ndarray, groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of each run of ``width`` neighbours of one group, in order."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = h * _MULT + values[k:k + n]
    first = np.flatnonzero(groups[:n] == groups[width - 1:])
    return mixed(h[first]), first
