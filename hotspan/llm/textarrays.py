"""Texts of an Arrow batch as flat numpy arrays: bytes, words and their hashes, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
PIECE = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """One-to-one scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


@cache
def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte, letters A-Z as their lower case."""
    values = mixed(np.arange(1, 257, dtype=np.uint64), 0x5DEECE66D)
    values[65:91] = values[97:123]
    return values


@cache
def is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run ``values[start:end]``, independent of where it stands; runs ascend and don't overlap.

    Each value is scrambled together with its place in its run before the sum, so that runs that a plain polynomial
    modulo 2^64 confuses stay apart.
    """
    n = len(values)
    place = np.arange(n, dtype=np.uint64)
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n]]))).astype(np.uint64)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        place *= np.uint64(MULTIPLIER)
        place += values
        shifted = place >> np.uint64(31)
        place ^= shifted
        place *= np.uint64(0x94D049BB133111EB)
        place ^= np.right_shift(place, np.uint64(29), out=shifted)
        np.cumsum(place, out=total[1:])
        return mixed(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """Some texts as one byte array; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and how many words come before each text (n + 1 values)."""
        inside = ~is_space()[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(inside) else inside
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(inside) else inside
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word in lower case (A-Z), and how many words come before each text."""
        starts, ends, first = self.words()
        return run_hashes(byte_values()[self.data], starts, ends), first


def text_pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, Texts]]:
    """(index of the first text, some texts in a row) until the column is through; a null is an empty text."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    if len(filled) == 0:
        return
    _, off, data = filled.buffers()
    offsets = np.frombuffer(off, np.int64)[filled.offset:filled.offset + len(filled) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(filled):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, Texts(data[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at])
        at = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
