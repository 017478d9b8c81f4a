"""Words and word runs of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. Texts are UTF-8, so
no byte of a longer character is taken for a space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

pa.set_memory_pool(pa.system_memory_pool())  # gives batches back to the system at once: workers live on

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_STEP_BASES = (0xF1357AEA2E62A9C5, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close numbers land far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LONGEST_KEPT = 1 << 20
_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """The first ``size`` powers of ``base`` modulo 2**64. One list a base is kept for the next call, unless it is long."""
    known = _kept_powers.get(base)
    if known is None or len(known) < size:
        known = np.full(1 << max(12, (size - 1).bit_length()) if size <= _LONGEST_KEPT else size, base, dtype=np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if size <= _LONGEST_KEPT:
            _kept_powers[base] = known
    return known[:size]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of every values[start:stop], independent of where it stands."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values)) if len(values) else values, out=sums[1:])
    inverse = _powers(_inverse(base), int(starts.max()) + 1 if len(starts) else 1)
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def hashes_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of byte spans."""
    return _spans(data.astype(np.uint64), starts, stops, _BASES[0])


class Words:
    """The words of a run of texts: byte spans, and the text that each is in."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, gaps: np.ndarray = SPACE):
        """data: bytes of all texts; ends: where each text starts, and at last the end; gaps: which bytes are in no word."""
        self.data, self.ends = data, ends
        space = gaps[data]
        before, after = np.empty(len(data), dtype=bool), np.empty(len(data), dtype=bool)
        if len(data):
            before[1:], before[0] = space[:-1], True
            after[:-1], after[-1] = space[1:], True
            before[ends[:-1][ends[:-1] < len(data)]] = True
            after[ends[1:][ends[1:] > 0] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.stops = np.flatnonzero(~space & after) + 1
        #: words of text i are those from first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, ends)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(ends) - 1), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return _spans(self.data.astype(np.uint64), self.starts, self.stops, _BASES[lane])

    def runs(self, hashes: np.ndarray, length: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``length`` words inside one text."""
        n = len(hashes) - length + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[length - 1:])
        return at, _spans(hashes, at, at + length, _STEP_BASES[lane])


def texts(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ends of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    return (LOWER[data] if lower else data), ends - ends[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``size`` bytes of text, at least one row each: bounds what numpy holds."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    totals, start = np.cumsum(lengths), 0
    while start < len(lengths):
        before = totals[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(totals, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]
