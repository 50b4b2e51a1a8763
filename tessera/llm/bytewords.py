"""Vectorised words and hashes over the UTF-8 buffers of Arrow string columns.

Texts are handled in runs of whole documents of about CHUNK bytes, so memory does not depend on the
batch; one document longer than that is a run by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000
#: Rows of a batch that are copied at a time.
ROWS = 1024
U64 = np.uint64
_R = U64(0x9E3779B97F4A7C15)
_RINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False  # [^\x20\x09-\x0D]+
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


class _Powers:
    """R**i and R**-i modulo 2**64, grown on demand."""

    up = down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK + 1)
            for name, r in (("up", _R), ("down", _RINV)):
                table = np.full(n, r, U64)
                table[0] = 1
                setattr(cls, name, np.multiply.accumulate(table))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hashes of data[start:end], from one prefix polynomial."""
    up, down = _Powers.get(len(data) + 1)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Run:
    """Whole documents: rows first..first+n of a batch, their bytes, and where each begins (n + 1 offsets)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def words(self, is_word: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (bytes) of all words, and the index of each document's first word (n + 1)."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        w = is_word[self.data]
        begin, stop = w.copy(), w.copy()
        begin[1:] &= ~w[:-1]
        stop[:-1] &= ~w[1:]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        begin[edge] = w[edge]
        stop[edge - 1] = w[edge - 1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, self.offsets)


def runs(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[Run]:
    """Runs of whole documents of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for at in range(0, len(column), ROWS):
        part = pc.fill_null(column.slice(at, ROWS).cast(pa.large_string()), "")
        _, off, buf = part.buffers()
        offsets = np.frombuffer(off, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(part):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1)
            yield Run(at + first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last


def crc_mod(ids: list, m: int) -> np.ndarray:
    """crc32 of the id as text, modulo m; a null id counts as an empty text."""
    from zlib import crc32

    return np.array([crc32(b"" if i is None else str(i).encode()) % m for i in ids], np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every (start, length), all in one array."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
