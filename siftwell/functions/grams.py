"""Trigram sets of texts on Arrow batches: the same sets as ``text.trigrams``, as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SYMBOLS = 37  #: letters, digits, and 0 for the blank
GRAMS = SYMBOLS**3
_FLAGS = 1 << 23  #: texts times trigrams that are marked in a table instead of sorted
_TEXT = " abcdefghijklmnopqrstuvwxyz0123456789"
_CODE = np.zeros(256, np.int32)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[ord("0") : ord("9") + 1] = np.arange(27, 37)


def gram_set(text: str | None) -> np.ndarray:
    """The distinct trigrams of the lower-cased ASCII words, each padded by two blanks before and one after; ascending."""
    c = _CODE[np.frombuffer((text or "").lower().encode(), np.uint8)]
    if not len(c):
        return np.zeros(0, np.int64)
    # every word's first letter gets two blanks before it, every word one blank after it
    first = (c > 0) & np.concatenate([[True], c[:-1] == 0])
    kept = np.flatnonzero(c > 0)
    at = kept + 2 * np.cumsum(first)[kept] - np.arange(len(c) + 1)[kept] + np.arange(len(kept))
    stream = np.zeros((int(at[-1]) + 2) if len(at) else 1, np.int64)
    stream[at] = c[kept]
    if len(stream) < 3:
        return np.zeros(0, np.int64)
    a, b, d = stream[:-2], stream[1:-1], stream[2:]
    valid = (b > 0) | ((a == 0) & (d > 0))
    return np.unique((a[valid] * SYMBOLS + b[valid]) * SYMBOLS + d[valid])


def slices(texts: list[str | None], most: int = 1 << 18) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters each, in order; one text at least."""
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def text_slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[slice, list[str | None]]]:
    """Runs of rows of about ``most`` bytes of a text column each, and their texts; only these become Python strings, whatever the batch holds."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        stop = min(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)) + 1, len(ends))
        yield slice(start, stop), column.slice(start, stop - start).to_pylist()
        start = stop


def gram_pairs(texts: list[str | None], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, trigram): the ``gram_set`` of each text, ``most`` bytes at a time, however long a text or a word is; ascending."""
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join([b" ", *raw, b""]), np.uint8)  # blanks part the words of two texts, two are before the first
    ends = np.cumsum([len(r) + 1 for r in raw]) + 2
    found = np.zeros(0, np.int64)
    for start in range(2, len(data), most):
        c = _CODE[data[start - 2 : start + most + 1]]
        at = np.flatnonzero(c[2 : most + 2]) + 2
        before, own = c[at - 1], c[at]
        code = (np.where(before > 0, c[at - 2], 0) * SYMBOLS + before) * SYMBOLS + own
        last = np.flatnonzero(np.append(c, 0)[at + 1] == 0)  # of a word: a blank follows
        first, end = np.searchsorted(ends, [start, min(start + most, len(data)) - 1], "right").tolist()
        sizes = np.diff(np.clip(ends[first:end], start, start + most), prepend=start, append=min(start + most, len(data)))
        owner = np.repeat(np.arange(end - first + 1) * GRAMS, sizes)[at - 2]
        codes = np.concatenate([owner + code, owner[last] + (before[last] * SYMBOLS + own[last]) * SYMBOLS])
        if (end - first + 1) * GRAMS <= _FLAGS:
            held = np.zeros((end - first + 1) * GRAMS, bool)
            held[codes] = True
            codes = np.flatnonzero(held)
        else:
            codes = np.unique(codes)
        codes += first * GRAMS
        # a text that goes on from the block before has trigrams of both
        shared = int(np.searchsorted(found, first * GRAMS)) if start > 2 else 0
        both = np.searchsorted(codes, (first + 1) * GRAMS)
        found = np.concatenate([found[:shared], np.union1d(found[shared:], codes[:both]), codes[both:]])
    return found // GRAMS, found % GRAMS


def gram_text(code: int) -> str:
    """The three characters of a trigram's number."""
    return "".join(_TEXT[code // SYMBOLS**k % SYMBOLS] for k in (2, 1, 0))


class QuerySets:
    """A block of query sets, as one row of flags for each trigram that any of them has."""

    def __init__(self, queries: list[str | None]):
        sets = [gram_set(q) for q in queries]
        self.size = np.array([len(s) for s in sets], np.int64)
        used = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        self.row = np.full(GRAMS, -1, np.int32)
        self.row[used] = np.arange(len(used))
        self.flags = np.zeros((len(used), len(sets)), np.uint8)
        for k, s in enumerate(sets):
            self.flags[self.row[s], k] = 1

    def close(self, texts: Iterator[str | None], threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(number of the text, queries, common trigrams, the text's trigrams) of texts with a similarity near ``threshold`` or over it."""
        for k, text in enumerate(texts):
            own = gram_set(text)
            rows = self.row[own]
            rows = rows[rows >= 0]
            if not len(rows):
                continue
            common = self.flags[rows].sum(0, dtype=np.int64)
            near = np.flatnonzero((common > 0) & (common >= (threshold - 1e-6) * (len(own) + self.size - common)))
            if len(near):
                yield k, near, common[near], len(own)
