"""Vectorised kernels over Arrow string columns, shared by the Arrow-batched operators.

Every kernel works on the UTF-8 bytes of a whole column slice at once.  The separators of both
word definitions are ASCII, and no byte of a multi-byte UTF-8 sequence is ASCII, so splitting bytes
and splitting code points give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa

U64 = np.uint64
T = TypeVar("T")

_codes = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, everything else as it is.
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
#: Words of `[^\x20\x09-\x0D]+`.
SPACED = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and everything beyond ASCII.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)


_held: dict[str, object] = {}
#: Gives free pages of the C heap back to the system, where the C library has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hold(name: str, build: Callable[[], T]) -> T:
    """One large object a worker process, kept between tasks; another one takes its place."""
    if name not in _held:
        _held.clear()
        _held[name] = build()
    return _held[name]


def release() -> None:
    """Let go of it: workers are reused, and what one operator keeps would weigh on the next."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEP = U64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=U64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), _STEP, dtype=U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text (one row at least each), which bounds what kernels hold."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """The words of a column: byte spans, and `first[d]:first[d + 1]` are the words of row d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, U64)
        size = self.end - self.start
        inside = np.concatenate(([0], np.cumsum(size)))
        within = np.arange(inside[-1]) - np.repeat(inside[:-1], size)
        at = within + np.repeat(self.start, size)
        terms = _BYTE[self.data[at]] * _power_table(int(size.max()))[within]
        return mix(np.add.reduceat(terms, inside[:-1]) + size.astype(U64) * _STEP)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()


def words(column: pa.Array, letters: np.ndarray, fold: bool) -> Words:
    """Split a column by a byte class, after lower-casing A-Z if `fold`."""
    data, offsets = utf8(column)
    if fold:
        data = LOWER[data]
    inside = letters[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of every run of k words within a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _STEP + hashes[j : j + n]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
    return at, mix(out[at])
