"""Vectorised work on batches of texts as UTF-8 bytes.

A batch of texts lies in one byte array with document offsets, and words, lines
and windows are found and hashed by whole-array operations. Batches are bounded
in bytes, so memory in a task does not depend on how many rows Spark sends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# Words of ASCII letters, digits and all bytes of other characters.
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]))
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Texts:
    """Texts of a slice of a batch: bytes, offsets and the row each came from."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as bytes and offsets; null is the empty text."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of a column in runs of about ``limit`` bytes; a longer text is a run of its own."""
    data, offsets = column_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield Texts(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row], row)
        row = stop


@dataclass
class Pieces:
    """Words or lines of a slice: byte range, row within the slice, hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of bytes [start, end) that depends on their content and number only."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def row_starts(texts: Texts, n: int) -> np.ndarray:
    """A flag at the first byte of every text that has one."""
    flags = np.zeros(n + 1, bool)
    flags[texts.offsets[:-1]] = True
    return flags[:n]


def words(texts: Texts, gap: np.ndarray = WHITE, lower: bool = True) -> Pieces:
    """Maximal runs of bytes that are no ``gap``; they never cross texts."""
    data, n = texts.data, len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none.astype(np.uint64))
    inside = ~gap[data]
    first = row_starts(texts, n)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(texts.offsets, start, "right") - 1
    sums = prefix_hash(LOWER[data] if lower else data)
    return Pieces(start, end, row, range_hash(sums, start, end))


def lines(texts: Texts) -> Pieces:
    """Parts between line feeds, empty ones included; a text of n line feeds has n + 1."""
    breaks = np.flatnonzero(texts.data == 10)
    row_of_break = np.searchsorted(texts.offsets, breaks, "right") - 1
    start = np.concatenate([texts.offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, texts.offsets[1:]])
    row_s = np.concatenate([np.arange(len(texts)), row_of_break])
    row_e = np.concatenate([row_of_break, np.arange(len(texts))])
    by_start, by_end = np.lexsort((start, row_s)), np.lexsort((end, row_e))
    start, end = start[by_start], end[by_end]
    return Pieces(start, end, row_s[by_start], range_hash(prefix_hash(texts.data), start, end))


def windows(pieces: Pieces, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first piece of every run of ``size`` consecutive pieces of one row."""
    n = len(pieces) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + pieces.hash[i:i + n]
    at = np.flatnonzero(pieces.row[:n] == pieces.row[size - 1:])
    return mix(total[at]), at


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """A flag for each of n places that lies in [start, start + size) of any start."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + size, n), -1)
    return np.cumsum(edges[:n]) > 0


def repeats(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in order: is there an equal key in the same row at all, and an earlier one?"""
    order = np.lexsort((key, row))  # stable, so equal items stay in order
    r, k = row[order], key[order]
    same = np.zeros(len(order), bool)
    same[1:] = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    any_equal = same.copy()
    any_equal[:-1] |= same[1:]
    twice, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order], later[order] = any_equal, same
    return twice, later
