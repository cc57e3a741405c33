"""Splits whole texts as the public byte-level BPE pattern does, for a slice of documents at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its
matches tile a text, so only the places where one begins are needed, and these follow from the classes of
neighbouring characters. ``tests/llm`` compares them with the pattern itself.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np
import regex

from siftwell.llm.textcodes import span_hashes

LETTER, NUMBER, OTHER, SPACE = range(4)


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    points = np.delete(np.arange(0x110000, dtype="<u4"), np.s_[0xD800:0xE000])
    every = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(what, every):
            out[points[m.start() : m.end()]] = kind
    return out


def split_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where matches begin in the texts of a slice, and each text's bounds in that list.

    Bytes are looked at, not characters: those of a longer character have its class, so no match begins inside of it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _classes()[:256].take(data)
    wide = np.flatnonzero(data >= 0x80)
    lead = (data[wide] & 0x40) != 0
    if len(wide):
        if not lead[0] or (~lead[1:] & (np.diff(wide) > 1)).any():
            data.tobytes().decode("utf-8")  # raises, as bytes of a character are apart
        cp = np.frombuffer(data[wide].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        char = np.cumsum(lead) - 1
        kind[wide] = _classes()[cp][char]
    doc_start = np.zeros(n + 4, bool)
    doc_start[offsets] = True  # also marks the end of the last text
    doc_start[n:] = True
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin |= doc_start[:n]
    space, blank = kind == SPACE, data == 32
    run = begin.copy()
    joined = run[1:] & ~space[1:] & blank[:-1] & ~doc_start[1:n]
    begin[1:] &= ~joined
    begin[:-1] |= space[:-1] & ~space[1:] & ~doc_start[1:n]
    if len(wide):  # the last white space of several may be a longer character: the match begins with its first byte
        late = np.flatnonzero(begin[wide] & ~lead)
        begin[wide[late]] = False
        begin[wide[lead][char[late]]] = True
    quote = np.flatnonzero((data == 39) & begin & run)
    if len(quote):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        same = ~doc_start[quote + 1]
        one, two = pad[quote + 1], pad[quote + 2]
        two = np.where(doc_start[quote + 2], 0, two)
        short = same & np.isin(one, [ord(c) for c in "stmd"])
        long = same & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        for which, size in ((short, 2), (long, 3)):
            at = quote[which]
            begin[at + 1] = False
            after = at + size
            begin[after[~doc_start[after]]] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offsets)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``starts``) of one span for each distinct byte string, and for each span the number of its string.

    Spans are grouped by hash and then compared byte by byte with the first of their group; those that differ
    from it are told apart by their bytes.
    """
    _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    lead = first[inverse]
    # spans tile the data, so each byte has one place in the first span of its group
    shift = np.repeat(starts[lead] - starts, size)
    other = np.minimum(np.arange(len(data)) + shift, len(data) - 1)
    wrong = np.flatnonzero(data.take(other) != data)
    alone = np.flatnonzero(size != size[lead])
    if len(wrong) or len(alone):
        differ = np.unique(np.concatenate([alone, np.searchsorted(starts, wrong, "right") - 1]))
        first_, known = first.tolist(), {}
        for i in differ.tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in known:
                known[word] = len(first_)
                first_.append(i)
            inverse[i] = known[word]
        first = np.array(first_)
    return first, inverse


def encode_slice(data: np.ndarray, offsets: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint32) of all texts of a slice and each text's bounds in them.

    ``encode`` gets the distinct matches as a list of bytes and returns their ids as a list of sequences.
    """
    starts, bounds = split_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    ends = np.append(starts[1:], len(data))
    first, inverse = distinct_spans(data, starts, ends)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    coded = encode(words)
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    flat = np.fromiter(chain.from_iterable(coded), np.uint32, int(size.sum()))
    at = np.concatenate([[0], np.cumsum(size)])
    count = size[inverse]
    ends_at = np.cumsum(count)
    index = np.repeat(at[inverse] - (ends_at - count), count) + np.arange(ends_at[-1])
    return flat[index], np.concatenate([[0], ends_at])[bounds]
