"""Vectorised text helpers used inside Arrow tasks.

Texts are handled as the UTF-8 bytes of an Arrow batch.  A batch is walked in
pieces of about a megabyte (one very long text makes one piece), so the memory
of a task does not follow the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUE = np.random.RandomState(20240501).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = True
WORD_BYTE[0x61:0x7B] = True
WORD_BYTE[0x80:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES + 2)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        have = (up, down)
        if size <= 1 << 22:
            _powers[0] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash gives the hash of any run of values."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], equal for equal runs wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, offsets (one more than rows) and validity; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.ones(len(column), dtype=bool)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0], valid


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `most` bytes together."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of true bytes; runs end at text bounds."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:n]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and text number of the words.

    A word is a run of 0-9, a-z (after lower-casing A-Z) and non-ASCII bytes.
    """
    low = lower(data)
    return (low, *runs(WORD_BYTE[low], bounds))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(byte_values(low)), starts, ends)


def window_hashes(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of `size` consecutive words of one text."""
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
    return first, span_hash(prefix_sums(hashes), first, first + size)


class HashTable:
    """A fixed set of 64-bit keys with rows, probed many keys at a time."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, dtype=np.uint64)
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.rows = np.full(size, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            free = self.rows[at] < 0
            slot, which = np.unique(at[free], return_index=True)
            rows = left[free][which]
            self.rows[slot] = rows
            self.keys[slot] = keys[rows]
            open_ = np.ones(len(left), dtype=bool)
            open_[np.flatnonzero(free)[which]] = False
            left, at = left[open_], (at[open_] + np.uint64(1)) & self.mask

    def __reduce__(self):
        full = self.rows >= 0
        keys = np.empty(int(full.sum()), np.uint64)
        keys[self.rows[full]] = self.keys[full]
        return HashTable, (keys,)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        at = mix(keys) & self.mask
        row = self.rows[at]
        ok = (row < 0) | (self.keys[at] == keys)
        if ok.all():
            return row
        left = np.flatnonzero(~ok)
        at = at[left]
        while len(left):
            at = (at + np.uint64(1)) & self.mask
            got = self.rows[at]
            done = (got < 0) | (self.keys[at] == keys[left])
            row[left[done]] = got[done]
            left, at = left[~done], at[~done]
        return row


class PackedTable(HashTable):
    """The same for few lookups and many keys: four bytes a slot beside the keys, which keep their order."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, dtype=np.uint64)
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(self.keys)) * 1.5))))
        self.mask = np.uint64(size - 1)
        self.rows = np.full(size, -1, dtype=np.int32)
        left, at = np.arange(len(self.keys)), mix(self.keys) & self.mask
        while len(left):
            free = self.rows[at] < 0
            slot, which = np.unique(at[free], return_index=True)
            self.rows[slot] = left[free][which]
            open_ = np.ones(len(left), dtype=bool)
            open_[np.flatnonzero(free)[which]] = False
            left, at = left[open_], (at[open_] + np.uint64(1)) & self.mask

    def __reduce__(self):
        return PackedTable, (self.keys,)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, dtype=np.int32)
        left, at = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            row = self.rows[at]
            same = (row >= 0) & (self.keys[row] == keys[left]) if len(self.keys) else np.zeros(len(left), bool)
            out[left[same]] = row[same]
            on = (row >= 0) & ~same
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return out
