"""Words of many texts at once, as flat numpy arrays.

Used inside Arrow batches. A word is a maximal run of bytes other than the six
ASCII white-space characters, which is the pattern [^\\x20\\x09-\\x0D]+ on UTF-8.
Nothing here loops over rows, so its cost is a few nanoseconds per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at a time; a longer text is handled alone, whole.
PIECE_BYTES = 1 << 20
HASHED_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = (1 << 64) - 1
# Two independent polynomial fingerprints: odd multipliers, their inverses
# modulo 2^64, and a random value per byte so that short words do not collide.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**64, (2, 256), np.uint64)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(which: int, inverse: bool, size: int) -> np.ndarray:
    """Powers 0 .. size - 1 of a multiplier or of its inverse."""
    known = _powers.get((which, inverse))
    if known is None or len(known) < size:
        base = pow(_MULTIPLIERS[which], -1, 1 << 64) if inverse else _MULTIPLIERS[which]
        known = np.full(max(size, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 2 * PIECE_BYTES:
            _powers[(which, inverse)] = known
    return known[:size]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprint of values[start:end] for each span; equal spans have equal ones."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(which, False, len(values)), out=prefix[1:])
    inverse = _power(which, True, len(values) + 1)
    raw = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def window_hashes(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Fingerprint of each run of ``size`` values, by its start."""
    starts = np.arange(max(0, len(values) - size + 1))
    return span_hashes(values, starts, starts + size, which)


def fold(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per row of integer columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = mix((out + np.uint64(0x9E3779B97F4A7C15)) ^ column.astype(np.uint64, copy=False))
    return out


@dataclass
class Words:
    """``raw`` holds the bytes of all texts, text i at offsets[i]:offsets[i + 1].

    Word j is raw[starts[j]:ends[j]]; the words of text i are first[i]:first[i + 1].
    """

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """Fingerprint of each word. Bytes are taken some at a time, as each needs several numbers meanwhile."""
        out = np.zeros(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            begin = self.starts[at]
            to = int(np.searchsorted(self.starts, begin + HASHED_BYTES))
            values = _BYTE_VALUES[which][self.raw[begin : self.ends[to - 1]]]
            out[at:to] = span_hashes(values, self.starts[at:to] - begin, self.ends[at:to] - begin, which)
            at = to
        return out

    def per_text(self, flags: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
        """Sum of ``flags`` (one per byte, or per word with bounds=first) in each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets if bounds is None else bounds])

    def window_starts(self, size: int) -> np.ndarray:
        """Word numbers at which a window of ``size`` words of one text starts."""
        fits = np.zeros(len(self.starts) + 1, np.int32)
        long = self.counts >= size
        np.add.at(fits, self.first[:-1][long], 1)
        np.add.at(fits, self.first[1:][long] - size + 1, -1)
        return np.flatnonzero(np.cumsum(fits[:-1]) > 0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds of each); a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, bounds, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words of a string column; ``lower`` turns A-Z into a-z."""
    raw, offsets = text_bytes(column)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[head] = inside[head]
    finishes[tail] = inside[tail]
    starts = np.flatnonzero(begins)
    return Words(raw, offsets, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets))


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def free_name(names: list[str], wanted: str) -> str:
    """``wanted``, or a variant that clashes with none of ``names``."""
    taken = {name.lower() for name in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
