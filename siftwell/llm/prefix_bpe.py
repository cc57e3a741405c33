"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

The last token of the encoding of a byte string is unique. Let last[i] be that token for the first i bytes;
it is the one token t ending there that may stand next to the last token of what precedes it. Two tokens may
stand side by side when merging their joint bytes leaves the seam alone, which is seen by undoing merges at
the seam from the latest to the earliest. So a table of one token per prefix holds the encodings of all
prefixes; bytes can be appended exactly, and an edit is re-encoded only until the table agrees again.

Matches of the pattern are encoded separately; a task keeps the ids of matches it has seen in a table of
bounded size. Decoding joins the bytes of ids.

Defined results for odd input: a null text is an empty one, with 0 ids; special token strings are ordinary
text; texts of any length are encoded whole; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.common import map_slices, worker_file
from siftwell.llm.pretokens import encode_slice
from siftwell.llm.textcodes import KeyTable, column_bytes

CACHE_WORDS = 100_000  #: matches a worker remembers
CACHE_BYTES = 4_000_000  #: and their bytes
CACHE_SEAMS = 400_000  #: pairs of tokens a worker remembers
STEPPED = 48  #: matches of up to so many bytes are filled in step with others, longer ones each by itself


def load_ranks(path: str) -> dict[bytes, int]:
    with open(worker_file(path), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Tokens by rank, the halves each was merged from, and a table of token prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, t in ranks.items():
            self.bytes[t] = b
        #: every prefix of a token -> the token's id, or -1 if the prefix itself is none
        self.prefixes: dict[bytes, int] = {}
        for b in ranks:
            for j in range(1, len(b)):
                self.prefixes.setdefault(b[:j], -1)
        self.prefixes.update(ranks)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        for b, t in sorted(ranks.items(), key=lambda x: x[1]):
            for j in range(1, len(b)):
                x, y = ranks.get(b[:j]), ranks.get(b[j:])
                if x is not None and y is not None and x < t and y < t and self._seam(x, y, t):
                    self.left[t], self.right[t] = x, y
                    break
        self._cache: dict[bytes, list[int]] = {}
        self._cached = 0
        self.tables = StepTables(self)

    def _seam(self, a: int, b: int, limit: int) -> bool:
        """True unless a merge across the seam of a and b comes before the merges that made them (and ``limit``)."""
        joined, names, left, right = self.ranks.get, self.bytes, self.left, self.right
        while True:
            t = joined(names[a] + names[b])
            if t is not None and t < limit:
                return False
            if a > b:
                if a not in right:
                    return True
                limit, a = a, right[a]
            else:
                if b not in left:
                    return True
                limit, b = b + 1, left[b]

    def apart(self, a: int, b: int) -> bool:
        """Whether token b may follow token a in an encoding."""
        key = (a, b)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > CACHE_SEAMS:
                self._apart.clear()
            known = self._apart[key] = self._seam(a, b, len(self.bytes))
        return known

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, remembered in a bounded table."""
        cache = self._cache
        if len(cache) > CACHE_WORDS or self._cached > CACHE_BYTES:
            cache.clear()
            self._cached = 0
        out = list(map(cache.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        short = [k for k in new if len(words[k]) <= STEPPED]
        for k, ids in zip(short, self.tables.encode([words[k] for k in short]), strict=True):
            out[k] = cache[words[k]] = ids
            self._cached += len(words[k])
        for k in new:
            if out[k] is None:
                out[k] = PrefixTable(self, words[k]).ids()
        return out


class StepTables:
    """The tables of prefixes and seams as arrays, to fill the last tokens of many short words in step."""

    def __init__(self, v: Vocabulary):
        self.size = np.array([len(b) for b in v.bytes])
        node = {b"": 0} | {p: k for k, p in enumerate(v.prefixes, 1)}
        self.token = np.array([-1, *v.prefixes.values()])
        #: (node of all but the last byte, last byte) -> node
        self.edges = KeyTable(np.array([node[p[:-1]] << 8 | p[-1] for p in v.prefixes], np.uint32))
        #: (a, b) -> the token of their joint bytes
        pairs, joint = [], []
        for b, t in v.ranks.items():
            for j in range(1, len(b)):
                x, y = v.ranks.get(b[:j]), v.ranks.get(b[j:])
                if x is not None and y is not None:
                    pairs.append(x << 16 | y)
                    joint.append(t)
        self.pairs, self.joint = KeyTable(np.array(pairs, np.uint32)), np.array([*joint, 1 << 30])
        n = len(v.bytes)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.left[list(v.left)], self.right[list(v.right)] = list(v.left.values()), list(v.right.values())

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each token b may follow its token a."""
        out = np.ones(len(a), bool)
        limit, at = np.full(len(a), 1 << 29), np.arange(len(a))
        while len(at):
            t = self.joint[self.pairs.find((a << 16 | b).astype(np.uint32))]
            bad = t < limit
            out[at[bad]] = False
            undo = a > b  # the later merge is undone first
            inner_a, inner_b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
            go = ~bad & (inner_a >= 0) & (inner_b >= 0)
            limit = np.where(undo, a, b + 1)[go]
            a, b, at = inner_a[go], inner_b[go], at[go]
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, from the last token of each of its prefixes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        first = (np.cumsum(size) - size)[order]
        size = size[order]
        base = first + order
        last = np.full(len(data) + len(size), -1)
        longest = int(size[0]) if len(size) else 0
        for i in range(longest):
            at = np.arange(np.searchsorted(-size, -i, "left"))  # words of more than i bytes
            node, before = np.zeros(len(at), np.int64), last[base[at] + i]
            if i and (before < 0).any():
                raise ValueError("the vocabulary lacks a byte of this text")
            j = i
            while len(at):
                node = self.edges.find((node << 8 | data[first[at] + j]).astype(np.uint32)).astype(np.int64) + 1
                j += 1
                on = node > 0
                at, node, before = at[on], node[on], before[on]
                token, place = self.token[node], base[at] + j
                ask = np.flatnonzero((token >= 0) & (last[place] < 0))
                if i and len(ask):
                    ask = ask[self.apart(before[ask], token[ask])]
                last[place[ask]] = token[ask]
                on = size[at] > j
                at, node, before = at[on], node[on], before[on]
        # from each word's end back to its start
        at, left, found, count = np.arange(len(size)), size.copy(), [], np.zeros(len(size), np.int64)
        while len(at):
            token = last[base[at] + left[at]]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a byte of this text")
            found.append((at, token))
            count[at] += 1
            left[at] -= self.size[token]
            at = at[left[at] > 0]
        end = np.cumsum(count)
        flat = np.empty(count.sum(), np.int64)
        for k, (at, token) in enumerate(found, 1):
            flat[end[at] - k] = token
        ids, at = flat.tolist(), [0, *end.tolist()]
        out: list[list[int]] = [[]] * len(words)
        for k, name in enumerate(order.tolist()):
            out[name] = ids[at[k] : at[k + 1]]
        return out


class PrefixTable:
    """The last token of every prefix of ``text``."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary = vocabulary
        self.text = b""
        self.last: list[int] = [-1]
        if text:
            self.append(text)

    def _fill(self, begin: int, stop_at: dict[int, int] | None = None) -> int | None:
        """Sets last[begin + 1:]. With ``stop_at`` (expected tokens by end), stops where a longest token's span agrees."""
        text, v, last = self.text, self.vocabulary, self.last
        n, prefixes, apart, names = len(text), v.prefixes, v.apart, v.bytes
        longest = max(map(len, names)) if stop_at is not None else 0
        first = 0 if stop_at is None and begin == 0 else max(0, begin - max(map(len, names)))
        agreed = 0
        for i in range(first, n):
            if i:
                if last[i] < 0:
                    raise ValueError("the vocabulary lacks a byte of this text")
                if stop_at is not None and i > begin:
                    agreed = agreed + 1 if stop_at.get(i) == last[i] else 0
                    if agreed >= longest:
                        return i
            before = last[i]
            for j in range(i + 1, n + 1):
                t = prefixes.get(text[i:j])
                if t is None:
                    break
                if t >= 0 and j > begin and last[j] < 0 and (i == 0 or apart(before, t)):
                    last[j] = t
        return None

    def append(self, more: bytes) -> None:
        """Adds bytes at the end: the tokens of all shorter prefixes stay as they are."""
        begin = len(self.text)
        self.text += more
        self.last += [-1] * len(more)
        self._fill(begin)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Puts ``new`` in place of text[start:end], re-encoding until the table agrees with the old one."""
        shift = len(new) - (end - start)
        old = self.last
        self.text = self.text[:start] + new + self.text[end:]
        self.last = old[: start + 1] + [-1] * (len(self.text) - start)
        expected = {i + shift: old[i] for i in range(end + 1, len(old))}
        done = self._fill(start, expected)
        if done is not None:
            self.last[done + 1 :] = old[done + 1 - shift :]

    def ids(self) -> list[int]:
        out, i, names = [], len(self.text), self.vocabulary.bytes
        while i:
            t = self.last[i]
            out.append(t)
            i -= len(names[t])
        return out[::-1]

    def prefix_ids(self, n: int) -> list[int]:
        """Ids of the first n bytes."""
        out, names = [], self.vocabulary.bytes
        while n:
            out.append(self.last[n])
            n -= len(names[self.last[n]])
        return out[::-1]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(load_ranks(path))
    return _loaded[path]


def decode(ids: Iterable[int], v: Vocabulary) -> bytes:
    return b"".join(map(v.bytes.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text by the rank file at ``path``."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = encode_slice(*column_bytes(part.column(1)), vocabulary(path).words)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], names=["doc_id", "ids"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes they decode to."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        ids, bounds = encode_slice(*column_bytes(part.column(1)), v.words)
        raw, values, at = ids.astype("<u4").tobytes(), ids.tolist(), bounds.tolist()
        spans = list(zip(at[:-1], at[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [
                part.column(0).cast(pa.int64()),
                pa.array(np.diff(bounds)),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans]),
                pa.array([hashlib.sha256(decode(values[a:b], v)).hexdigest() for a, b in spans]),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
