"""A bounded table of the matches a worker has encoded, asked for all matches of a slice at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from siftwell.llm.pretokens import split_bounds
from siftwell.llm.textcodes import _LOW_BYTES, mix64

_WIDTH = 15  #: bytes of a match that is kept in columns
_U = np.uint64


class SeenMatches:
    """Ids of matches by their bytes.

    A match of up to 15 bytes is known by two numbers, its bytes and in the last place its size, so equal keys are equal matches; they
    are found by open addressing. The few longer ones are kept in a dictionary. ``encode`` gets distinct matches and returns
    their ids one after another and how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.held = 1  # rows in use; row 0 is no match
        self.low, self.high = np.zeros(1, np.uint64), np.zeros(1, np.uint64)  # a match in the dictionary has two zeros
        self.first = np.zeros(2, np.int64)  # a row's ids end where those of the next row begin
        self.ids, self.n_ids = np.zeros(1, np.uint32), 0
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self._empty(16)

    def _empty(self, bits: int) -> None:
        self.bits, self.slot = bits, np.zeros(1 << bits, np.int32)

    def _code(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix64(high * _U(0x9FB21C651E98DF25) ^ low)

    def _at(self, code: np.ndarray) -> np.ndarray:
        return (code >> _U(64 - self.bits)).astype(np.int64)

    def _put(self, name: str, start: int, values: np.ndarray) -> None:
        column = getattr(self, name)
        if start + len(values) > len(column):
            column = np.concatenate([column, np.zeros(max(len(column), len(values)), column.dtype)])
            setattr(self, name, column)
        column[start : start + len(values)] = values

    def _add(self, words: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows of new distinct matches; those with a ``high`` of 0 are in the dictionary, not in the slots."""
        ids, count = self.encode(words)
        rows = self.held + np.arange(len(words))
        self._put("low", self.held, low)
        self._put("high", self.held, high)
        self._put("first", self.held + 1, self.n_ids + np.cumsum(count))
        self._put("ids", self.n_ids, ids)
        self.held += len(words)
        self.n_ids += len(ids)
        if 2 * self.held > len(self.slot):
            self._empty((4 * self.held).bit_length())
            rows = np.arange(1, self.held)
        todo = rows[self.high[rows] > 0]
        at = self._at(self._code(self.low[todo], self.high[todo]))
        while len(todo):
            free = self.slot[at] == 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], at[lost] + 1 & len(self.slot) - 1
        return rows[-len(words) :]

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each match, new ones included."""
        size = ends - starts
        eight = np.ndarray((len(data) + 9,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        low = eight.take(starts) & _LOW_BYTES.take(np.minimum(size, 8))
        high = size.astype(np.uint64) << _U(56)
        over = np.flatnonzero(size > 8)
        more = size.take(over) - 8
        high[over] |= eight.take(starts.take(over) + 8) & _LOW_BYTES.take(np.minimum(more, _WIDTH - 8))
        wide = over[more > _WIDTH - 8]
        code = self._code(low, high)
        row = self.slot.take(self._at(code)).astype(np.int64)
        row[wide] = 0
        todo = np.flatnonzero((self.low.take(row) != low) | (self.high.take(row) != high))
        same = lambda k: (self.low[row[k]] == low[k]) & (self.high[row[k]] == high[k])
        at = self._at(code[todo])
        while True:
            on = row[todo] > 0
            todo, at = todo[on], at[on] + 1 & len(self.slot) - 1
            if not len(todo):
                break
            row[todo] = self.slot[at]
            other = ~same(todo)
            todo, at = todo[other], at[other]
        raw = data.tobytes()
        words_at = lambda k: [raw[a:b] for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)]
        row[wide] = -1
        new = np.flatnonzero(row == 0)
        while len(new):
            _, lead, group = np.unique(code[new], return_index=True, return_inverse=True)
            lead = new[lead]
            row[new] = self._add(words_at(lead), low[lead], high[lead])[group]
            new = new[~same(new)]  # of equal codes, other matches
        if len(wide):
            words = words_at(wide)
            fresh = [w for w in dict.fromkeys(words) if w not in self.long]
            if fresh:
                none = np.zeros(len(fresh), np.uint64)
                self.long.update(zip(fresh, self._add(fresh, none, none).tolist(), strict=True))
                self.long_bytes += sum(map(len, fresh))
            row[wide] = [self.long[w] for w in words]
        return row

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray, most: int, most_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts of a slice and each text's bounds in them. A table beyond ``most`` matches or ``most_bytes`` of long ones is emptied first."""
        if self.held > most or self.long_bytes > most_bytes:
            self.clear()
        starts, bounds = split_bounds(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        row = self.rows(data, starts, np.append(starts[1:], len(data)))
        first = self.first.take(row)
        count = self.first.take(row + 1) - first
        ends = np.cumsum(count)
        index = np.repeat(first - (ends - count), count)
        index += np.arange(ends[-1])
        return self.ids.take(index), np.concatenate([[0], ends])[bounds]
