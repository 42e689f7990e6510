"""Words of many texts at once, on the bytes of an Arrow column.

A batch of texts is turned into one byte buffer in which words are joined by
single spaces, with word positions and 64-bit word hashes beside it. All steps
are array operations over the batch; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


BYTE_HASH = _splitmix(256, 0xA5A5)
BYTE_HASH[0x20] = 0
STEP = _U(0x9E3779B97F4A7C55)
WORD_STEP = _U(0xD6E8FEB86659FD93)
_power = [np.ones(1, dtype=_U)]


def _powers(n: int) -> np.ndarray:
    if len(_power[0]) < n:
        p = np.full(max(n, 256), STEP, dtype=_U)
        p[0] = 1
        _power[0] = np.multiply.accumulate(p)
    return _power[0]


def white_space_table(lower: bool) -> np.ndarray:
    """Bytes to bytes: 0x20 and 0x09-0x0D part words; A-Z become a-z if lower."""
    t = np.arange(256, dtype=np.uint8)
    t[0x09:0x0E] = 0x20
    if lower:
        t[0x41:0x5B] += 0x20
    return t


def alphanumeric_table() -> np.ndarray:
    """Bytes to bytes: A-Z become a-z; what is no ASCII letter, digit or part of a character beyond ASCII parts words."""
    t = np.full(256, 0x20, dtype=np.uint8)
    t[0x30:0x3A] = np.arange(0x30, 0x3A)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


class Words:
    """Words of the texts of one slice. first[d]:first[d + 1] are those of text d."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        m = table[raw]
        inside = m != 0x20
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(m)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        # a word ends where the next byte is outside, or where its text ends
        after = np.empty_like(inside)
        if len(inside):
            after[-1] = False
            after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        length = np.flatnonzero(inside & ~after) + 1 - starts
        self.length = length
        self.start = np.cumsum(length + 1) - (length + 1)
        self.first = np.searchsorted(starts, offsets)
        self.text = np.full(int((length + 1).sum()), 0x20, dtype=np.uint8)
        if len(length):
            at = np.ones(int(length.sum()), dtype=np.int64)
            at[0] = 0
            at[np.cumsum(length)[:-1]] = 2
            self.text[np.cumsum(at)] = m[inside]
        self.n = len(length)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not self.n:
            return np.empty(0, dtype=_U)
        local = np.arange(len(self.text), dtype=np.int32) - np.repeat(self.start.astype(np.int32), self.length + 1)
        v = BYTE_HASH[self.text] * _powers(int(self.length.max()) + 1)[local]
        return mix(np.add.reduceat(v, self.start))

    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def bytes_of(self, a: int, b: int) -> bytes:
        """Words a to b, b excluded, joined by one space."""
        return self.text[self.start[a] : self.start[b - 1] + self.length[b - 1]].tobytes() if b > a else b""


def window_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, across texts; empty if there are fewer words."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=_U)
    h = np.full(count, n, dtype=_U)
    for k in range(n):
        h = h * WORD_STEP + word_hashes[k : k + count]
    return mix(h)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and byte offsets of slices of about limit bytes; a longer text is a slice. Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j
