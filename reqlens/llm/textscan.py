"""Vectorised word scanning of Arrow text columns, shared by the operators.

Texts are read as one UTF-8 byte buffer in slices of about ``SLICE_BYTES``, so
memory is bounded by the slice (or by one text, if that is longer) and not by
the record batch. Every separator used by the operators is an ASCII byte, which
never occurs inside a multi-byte character: words can be cut on bytes.

A word's 64-bit hash is a polynomial of its bytes modulo 2**64 with a fixed odd
base, then mixed. A shingle's hash combines word hashes the same way. Where an
operator needs exact equality it says how hash collisions are ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_PIECE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD1342543DE82EF95)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_LENGTH = np.uint64(0x2545F4914F6CDD1D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, _PIECE + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of the batch holding about ``most`` text bytes
    each (a longer text has a range of its own)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end

_VALUES = (np.arange(1, 257, dtype=np.uint64), mix(np.arange(1, 257, dtype=np.uint64)))


class Words:
    """The words of a slice of texts: ``start``/``end`` byte positions in
    ``buf``; words ``first[d]:first[d + 1]`` belong to text d."""

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool = True,
                 runs_of: np.ndarray | None = None) -> None:
        raw, self.offsets = text_buffer(column)
        self.buf = LOWER[raw] if lower else raw
        n = len(self.buf)
        inside = table[self.buf]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        if runs_of is not None:  # a change of byte class also ends a word
            kind = runs_of[raw]
            cut[1:n] |= kind[1:] != kind[:-1]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before &= ~cut[:n]
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after &= ~cut[1:n + 1]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, second: bool = False) -> np.ndarray:
        """64-bit hashes of the words; the second family reads other values of
        the bytes and is independent of the first."""
        value = _VALUES[int(second)]
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(self.start):  # pieces of about _PIECE bytes, cut between words
            base = int(self.start[i])
            j = max(int(np.searchsorted(self.end, base + _PIECE, side="right")), i + 1)
            stop = int(self.end[j - 1])
            up, down = _power_tables(stop - base + 1)
            sums = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum(value[self.buf[base:stop]] * up[:stop - base], out=sums[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _LENGTH
            i = j
        return mix(out)

    def shingles(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of every k consecutive words of one text."""
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        last = np.repeat(self.first[1:], self.count)
        at = np.flatnonzero(np.arange(n) + k <= last[:n])
        return at, combine(h, k)[at]


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i + k] for every i, as if all words were one text."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j:j + n]
    return mix(out + np.uint64(k * int(_LENGTH) % (1 << 64)))


def hash_words(words: list[bytes]) -> np.ndarray:
    """Hashes of separate words, equal to those ``Words.hashes`` gives."""
    w = Words(pa.array([b" ".join(words)], pa.binary()), NOT_SPACE, lower=False)
    return w.hashes()


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of h[start:end] for every pair, whatever the lengths."""
    up, down = _power_tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[:len(h)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _LENGTH)
