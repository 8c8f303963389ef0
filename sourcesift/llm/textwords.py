"""Vectorised words and rolling hashes over Arrow string columns.

Nothing here is done per row in Python: a batch of texts is one byte buffer, word bounds come from a
byte table, and hashes are 64-bit polynomials of table-mixed bytes. Very long texts only make one
chunk larger; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK_BYTES = 1 << 20


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """1, b, b², … modulo 2⁶⁴, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.values = np.uint64(base | 1), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            with np.errstate(over="ignore"):
                top = self.values[-1] * self.base
                self.values = np.concatenate([self.values, self.values * top])
        return self.values[:n]


BYTE_CODE = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
_WORD = Powers(0x9E3779B97F4A7C15)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes: (first row, end row, bytes, offsets)."""
    data, at = text_buffer(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_bounds(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end offsets of the words, and n+1 word offsets of the rows; words end at row ends."""
    inside = is_word[data]
    starts, ends = inside.copy(), np.zeros(len(data) + 1, bool)
    firsts = at[:-1][at[:-1] < at[1:]]  # of rows that hold bytes
    if len(data):
        starts[1:] &= ~inside[:-1]
        starts[firsts] = inside[firsts]
        ends[1:-1] = inside[:-1] & ~inside[1:]
        ends[-1] = inside[-1]
        lasts = firsts[1:]
        ends[lasts] = inside[lasts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(s, at)


def table(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bytes | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, after mapping bytes through ``fold``."""
    if not len(s):
        return np.zeros(0, np.uint64)
    code = BYTE_CODE[np.frombuffer(fold, np.uint8)] if fold else BYTE_CODE
    size = e - s
    power = _WORD.upto(int(size.max()))
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        values = code[data[within + np.repeat(s, size)]] * power[within]
        return splitmix(np.add.reduceat(values, first) + size.astype(np.uint64))


def gram_hashes(units: np.ndarray, k: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hashes of all runs of ``k`` units of one sequence: a Horner sum by doubling; length n-k+1."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, step = np.zeros(n, np.uint64), 0, 1
        run, b = units.astype(np.uint64, copy=False), np.uint64(base | 1)
        while True:  # run[i]: hash of the ``step`` units at i
            if k & step:
                out = out * _pow(b, step) + run[done : done + n]
                done += step
            if done == k:
                return splitmix(out)
            run = run[:-step] * _pow(b, step) + run[step:]
            step *= 2


def _pow(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each unit, from n+1 offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
