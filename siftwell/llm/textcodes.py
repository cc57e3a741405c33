"""Vectorised views of Arrow text columns: slices of bounded size, words, word hashes.

All helpers work on the UTF-8 bytes of a slice of documents at once, so the
per-document Python cost stays small and the memory of a task is bounded by
``SLICE_BYTES`` (or by the largest single text, when that is larger).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = ~_SPACE
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (two xor-shift-multiply rounds)."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  #: masks of the first k bytes of eight
_WIDE = 64  #: spans of more bytes are hashed one by one


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time, and xxh3 for the few spans over ``_WIDE`` bytes."""
    size = ends - starts
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix64((eight[starts] & _LOW_BYTES[np.minimum(size, 8)]) ^ mix64(size.astype(np.uint64) + _U(1)))
    more = np.flatnonzero((size > 8) & (size <= _WIDE))
    at = 8
    while len(more):
        h[more] = mix64(h[more] ^ (eight[starts[more] + at] & _LOW_BYTES[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > _WIDE).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; a null is an empty text."""
    col = col.fill_null("") if col.null_count else col
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most ``limit`` text bytes (one row at least)."""
    if not batch.num_rows:
        return
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words (runs of bytes other than blank and 0x09-0x0D) of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        w = _WORD[data]
        s, e = w.copy(), w.copy()
        if n:
            s[1:] &= ~w[:-1]
            e[:-1] &= ~w[1:]
            full = offsets[1:] > offsets[:-1]
            first, last = offsets[:-1][full], offsets[1:][full] - 1
            s[first] = w[first]
            e[last] = w[last]
        self.starts = np.flatnonzero(s)
        self.ends = np.flatnonzero(e) + 1
        #: words of document d are those from bounds[d] to bounds[d + 1]
        self.bounds = np.searchsorted(self.starts, offsets)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z lowered first if asked)."""
        return span_hashes(_LOWER[self.data] if lower else self.data, self.starts, self.ends)


def windows(codes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive codes inside each document, and their bounds.

    A document with fewer codes than ``width`` (but at least one) has one window of all of them.
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], count) + np.arange(out_bounds[-1])
    last = np.repeat(bounds[1:], count)
    h = np.zeros(len(first), np.uint64)
    for k in range(width):
        at = first + k
        inside = at < last
        c = codes[np.minimum(at, len(codes) - 1)] if len(codes) else codes
        h = np.where(inside, (h + c) * _U(0x9FB21C651E98DF25 + 2 * k), h)
    return mix64(h), out_bounds


def occurrence(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many equal codes stand before each one in its document."""
    if not len(codes):
        return np.zeros(0, np.int64)
    order = np.lexsort((codes, doc))
    c, d = codes[order], doc[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    at = np.arange(len(c))
    out = np.empty(len(c), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


class KeyTable:
    """Rows by uint32 key: open addressing, probed for all keys at once. Unknown keys get row -1."""

    def __init__(self, keys: np.ndarray):
        bits = min(31, max(8, int(len(keys) * 4).bit_length()))
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.row = np.full(1 << bits, -1, np.int32)
        self.keys = keys.astype(np.uint32)
        todo, slot = np.arange(len(keys)), self._slot(self.keys)
        while len(todo):
            free = self.row[slot] < 0
            self.row[slot[free]] = todo[free]
            lost = self.row[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        out = self.row[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            got = self.row[slot]
            out[todo] = got
            more = (got >= 0) & (self.keys[got] != keys[todo])
            todo, slot = todo[more], slot[more]
        return out
