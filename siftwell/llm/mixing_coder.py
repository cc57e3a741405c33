"""Token-id files coded by an adaptive context-mixing range coder.

Order 2 and order 1 each predict one id, the one that has followed the last two ids, or the last one, before. A
first symbol says which of them is right, or that neither is. Its probabilities are a mixture of three adaptive
distributions: one given the trust in both predictions, one given the trust in order 1, and one given nothing; the
weights of the mixture follow how well each has predicted, by steps of expectation maximisation. Where both
predictions fail, the id itself is coded by adaptive order-0 frequencies, summed up anew at intervals. All drive one
range coder. All arithmetic is in integers, so any machine decodes.

Models are reset at every block of ``BLOCK`` ids, so blocks are independent. The ids of a block are dealt into up to
``STREAMS`` streams that are coded in step, each with its own range, and all with the block's one model: it
learns from all streams after every step, so it has seen many ids after a few steps, and numpy works on all
streams at once.

A token file is a Parquet dataset written by Spark, one row per block: its place in the id stream, the documents that
have ids in it, and a payload of magic, version, id count, CRC-32 of the ids, the code length of each stream
and the code. Any reader task can decode any block; a wrong checksum is an error.

Defined results for odd input: a null or empty text is the end id alone; rows come in ascending doc_id order,
null ids first, rows of one id in any order; a special token's string in a text is what the library makes of it; ids of
``ALPHABET`` or more raise ValueError; repeated rows are written each; an empty table is an empty dataset; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, worker_file
from siftwell.llm.matches import SeenMatches
from siftwell.llm.textcodes import column_bytes, slices

BLOCK = 1 << 20
STREAMS = 8192
SHORTEST = 64  #: ids of a stream at least, where a block has more than one
END_ID = 0
ALPHABET = 1 << 16
MAGIC, VERSION = b"SWID", 2
_HEAD = struct.Struct("<4sBIII")  #: magic, version, ids, crc32, streams

_SLOTS = 1 << 18  #: of order 2, by a hash of the last two ids
_SEEN = 24  #: weight of an id seen, against 1 for any id
_PARTS = 15  #: bits of the parts that an order-0 value is looked for by
_NEXT = 2  #: ids looked at one after another there, before the rest is searched
_FULL = 1 << 16  #: a row of choices is halved beyond so many
_ROWS = 128  #: trust in order 2 (8), trust in order 1 (8), whether both predict the same id
_TRUST_2, _TRUST_1, _SAME = np.arange(_ROWS) >> 4, (np.arange(_ROWS) >> 1) & 7, np.arange(_ROWS) & 1
_U = np.uint64
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 44)


_REPLACE = np.int32(8)  #: in place of what is added to a slot whose id is replaced


def _after(trust: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What is added to a slot, by 3 * row + choice: trust grows by one or is halved, an id without trust goes."""
    trust = trust[:, None]
    add = np.where(right, trust < 7, -((trust + 1) >> 1))
    return np.where(~right & (trust < 2), _REPLACE, add).astype(np.int32).ravel()


_ADD_2 = _after(_TRUST_2, np.arange(3)[None, :] == np.zeros((_ROWS, 1)))
_ADD_1 = _after(_TRUST_1, (np.arange(3)[None, :] == 1) | ((np.arange(3)[None, :] == 0) & (_SAME == 1)[:, None]))


class _Model:
    """What a block's ids have taught so far. All streams of the block share it."""

    def __init__(self) -> None:
        # 8 * the id that followed last time + how often it was right of late (0 to 7)
        self.order_2, self.order_1 = np.zeros(_SLOTS, np.int32), np.zeros(ALPHABET, np.int32)
        self.upper = np.arange(ALPHABET + 1, dtype=np.uint32)  # sums of the order-0 frequencies
        self.waiting: list[np.ndarray] = []  # ids the order-0 frequencies have not taken in
        self.summed, self.parts_of = 0, -1
        # counts of {order 2 is right, order 1 is right, neither} given nothing, one trust, both trusts
        self.counts = [np.ones((n, 3), np.int64) for n in (1, 8, _ROWS)]
        self.weights = np.full((3, _ROWS), 1365)
        self.seen = np.zeros(3 * _ROWS, np.int64)
        self._mix()

    def _mix(self) -> None:
        one, two, three = ((c << 16) // c.sum(1, keepdims=True) for c in self.counts)
        self.parts = np.stack([np.broadcast_to(one, three.shape), two[_TRUST_1], three])
        self.mixed = np.maximum((self.parts * self.weights[:, :, None]).sum(0) >> 12, 1)
        f = 1 + (self.mixed[:, :2] * 65528 >> 16)
        #: choices of row r are [first[r], second[r]) and so on, of 65536
        self.first, self.second = f[:, 0].astype(np.uint64), (f[:, 0] + f[:, 1]).astype(np.uint64)
        none, all_ = np.zeros(_ROWS, np.uint64), np.full(_ROWS, 65536, np.uint64)
        self.lower = np.stack([none, self.first, self.second], axis=1).ravel()
        self.share = np.stack([self.first, self.second - self.first, all_ - self.second], axis=1).ravel()

    def look(self, one: np.ndarray, two: np.ndarray) -> None:
        """The predictions after the ids ``one`` (last) and ``two`` (before it)."""
        self.at_2, self.at_1 = (one * 0x9E3779B1 ^ two * 0x85EBCA77) >> 13 & (_SLOTS - 1), one
        self.held_2, self.held_1 = self.order_2.take(self.at_2), self.order_1.take(one)
        self.guess_2, self.guess_1 = self.held_2 >> 3, self.held_1 >> 3
        self.row = ((((self.held_2 & 7) << 3 | self.held_1 & 7) << 1) + (self.guess_2 == self.guess_1)).astype(np.int64)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose order-0 share holds the values ``v``: the first of the part of all values that ``v`` is in, or one after it."""
        if self.parts_of != self.summed:
            self.parts_of = self.summed
            self.shift = np.uint32(max(0, int(self.upper[-1]).bit_length() - _PARTS))
            # an id counts from the first part that begins in its share
            first = self.upper[1:-1] + ((np.uint32(1) << self.shift) - np.uint32(1)) >> self.shift
            self.near = np.cumsum(np.bincount(first, minlength=(1 << _PARTS) + 1), dtype=np.int32)
        at = self.near.take(v >> self.shift)
        todo = np.flatnonzero(self.upper.take(at + 1) <= v)
        for _ in range(_NEXT):
            if not len(todo):
                return at
            at[todo] += 1
            todo = todo[self.upper.take(at[todo] + 1) <= v[todo]]
        at[todo] = np.searchsorted(self.upper, v[todo], "right") - 1
        return at

    def learn(self, t: int, ids: np.ndarray, state: np.ndarray) -> None:
        """Takes in the ids of step ``t``, coded in ``state`` (3 * row + choice). Of streams in one context the last counts."""
        moved = (ids << 3).astype(np.int32)
        for slots, at, held, add in ((self.order_2, self.at_2, self.held_2, _ADD_2), (self.order_1, self.at_1, self.held_1, _ADD_1)):
            add = add.take(state)
            slots[at] = np.where(add == _REPLACE, moved, held + add)
        self.seen += np.bincount(state, minlength=3 * _ROWS)
        self.waiting.append(ids)
        if t < 16 or t % 8 == 7:
            self._weigh()
            self._mix()
        if len(self.waiting) > min(self.summed // 4, 7):
            count = np.bincount(np.concatenate(self.waiting), minlength=ALPHABET)
            self.upper[1:] += np.cumsum(count, dtype=np.uint32) * np.uint32(_SEEN)
            self.summed += len(self.waiting)
            self.waiting = []

    def _weigh(self) -> None:
        seen = self.seen.reshape(_ROWS, 3)
        n = seen.sum(1)
        gain = ((self.parts << 12) // self.mixed * seen).sum(2) // np.maximum(n, 1)
        moved = np.where(n > 0, (3 * self.weights + (self.weights * gain >> 12)) >> 2, self.weights)
        moved = np.maximum(moved, 32)
        self.weights = (moved << 12) // moved.sum(0)
        self.counts[0] += seen.sum(0)
        self.counts[1] += seen.reshape(8, 8, 2, 3).sum((0, 2))
        self.counts[2] += seen
        for c in self.counts:
            full = c.sum(1) > _FULL
            if full.any():
                c[full] = (c[full] + 1) >> 1
        self.seen = np.zeros(3 * _ROWS, np.int64)


class _Ranges:
    """The ranges of the streams: all values from low to low + width - 1 code what has been coded."""

    def __init__(self, n: int):
        self.low, self.width = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)

    def due(self, lanes: np.ndarray | None = None) -> np.ndarray:
        """Those of ``lanes`` (all if None) whose first 16 bits are settled, or must be as the range has become small."""
        low, width = self.low, self.width
        if lanes is not None:  # no first bits are settled in a range of more than 2^48: few are left after a shift
            width = width.take(lanes)
            few = np.flatnonzero(width <= _TOP)
            lanes, width = lanes.take(few), width.take(few)
            low = low.take(lanes)
        settled = (low ^ (low + (width - _U(1)))) < _TOP
        small = (width < _BOTTOM) > settled
        if small.any():
            at = np.flatnonzero(small)
            self.width[at if lanes is None else lanes[at]] = (_U(0) - low[at]) & (_BOTTOM - _U(1))
            settled |= small
        return np.flatnonzero(settled) if lanes is None else lanes[settled]

    def shift(self, lanes: np.ndarray) -> None:
        self.low[lanes] = self.low.take(lanes) << _U(16)
        width = self.width.take(lanes) << _U(16)
        self.width[lanes] = width - (width == 0)  # a width of 2^48 would become 2^64: one less


def _shape(n: int) -> tuple[int, int]:
    """Streams of a block of ``n`` ids and ids of each; the last ones may be filled up with zeros."""
    if not n:
        return 0, 0
    steps = -(-n // max(1, min(STREAMS, n // SHORTEST)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray) -> bytes:
    """The payload of a block of ids below ``ALPHABET``."""
    if len(ids) and int(ids.max()) >= ALPHABET:
        raise ValueError(f"an id of {ALPHABET} or more")
    n, steps = _shape(len(ids))
    rows = np.zeros((n, steps), np.uint32)
    rows.reshape(-1)[: len(ids)] = ids
    rows = np.ascontiguousarray(rows.T)
    model, ranges = _Model(), _Ranges(n)
    low, width = ranges.low, ranges.width
    who, out = [], []  # streams that put out 16 bits, and these
    one = two = np.zeros(n, np.int64)
    for t in range(steps):
        x = rows[t].astype(np.int64)
        model.look(one, two)
        miss = model.guess_2 != x
        both = miss & (model.guess_1 != x)
        state = 3 * model.row + miss + both
        step = width >> _U(16)
        low += step * model.lower.take(state)
        np.multiply(step, model.share.take(state), out=width)
        rest = np.flatnonzero(both)
        if len(rest):
            own = x.take(rest)
            lower = model.upper.take(own)
            step = width.take(rest) // _U(model.upper[-1])
            low[rest] += step * lower
            width[rest] = step * (model.upper.take(own + 1) - lower)
        lanes = ranges.due()
        while len(lanes):
            who.append(lanes.astype(np.uint16))
            out.append((low.take(lanes) >> _U(48)).astype(np.uint16))
            ranges.shift(lanes)
            lanes = ranges.due(lanes)
        model.learn(t, x, state)
        one, two = x, one
    # 32 bits tell a value inside the last range, which is no smaller than _BOTTOM; the rest may be zeros
    last = (low + _U((1 << 32) - 1)) >> _U(32)
    who = np.concatenate([*who, np.arange(n, dtype=np.uint16), np.arange(n, dtype=np.uint16)])
    out = np.concatenate([*out, (last >> _U(16)).astype(np.uint16), last.astype(np.uint16)])
    code = out.take(np.argsort(who, kind="stable")).astype("<u2").tobytes()
    head = _HEAD.pack(MAGIC, VERSION, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), n)
    return head + np.bincount(who, minlength=n).astype("<u2").tobytes() + code


def decode_block(payload: bytes) -> np.ndarray:
    """The ids of a payload; a damaged one raises ValueError."""
    if len(payload) < _HEAD.size or payload[:4] != MAGIC or payload[4] != VERSION:
        raise ValueError("not a token block of this version")
    _, _, size, crc, streams = _HEAD.unpack_from(payload)
    n, steps = _shape(size)
    if size > BLOCK or streams != n or len(payload) < _HEAD.size + 2 * n:
        raise ValueError("token block of another shape")
    length = np.frombuffer(payload, "<u2", n, _HEAD.size).astype(np.int64)
    if len(payload) != _HEAD.size + 2 * n + 2 * int(length.sum()):
        raise ValueError("token block of another length")
    # each stream's code is followed by zeros; what is read beyond them, if it is damaged, fails the checksum
    across = int(length.max(initial=0)) + 4
    code = np.zeros((n, across), np.uint16)
    code[np.arange(across) < length[:, None]] = np.frombuffer(payload, "<u2", -1, _HEAD.size + 2 * n)
    model, ranges = _Model(), _Ranges(n)
    low, width = ranges.low, ranges.width
    value = np.zeros(n, np.uint64)
    for k in range(4):
        value = value << _U(16) | code[:, k]
    at, code = np.arange(4, 4 + n * across, across), code.ravel()
    rows = np.zeros((steps, n), np.uint32)
    one = two = np.zeros(n, np.int64)
    for t in range(steps):
        model.look(one, two)
        step = width >> _U(16)
        v = (value - low) // step
        second = model.second.take(model.row) <= v
        choice = (model.first.take(model.row) <= v).astype(np.int64) + second
        state = 3 * model.row + choice
        low += step * model.lower.take(state)
        np.multiply(step, model.share.take(state), out=width)
        x = np.where(choice == 0, model.guess_2, model.guess_1).astype(np.int64)
        rest = np.flatnonzero(second)
        if len(rest):
            total = _U(model.upper[-1])
            step, ahead = width.take(rest), low.take(rest)
            step //= total
            v = np.minimum((value.take(rest) - ahead) // step, total - _U(1)).astype(np.uint32)
            own = model.find(v)
            lower = model.upper.take(own)
            low[rest] = ahead + step * lower
            width[rest] = step * (model.upper.take(own + 1) - lower)
            x[rest] = own
        lanes = ranges.due()
        while len(lanes):
            place = at.take(lanes)
            value[lanes] = value.take(lanes) << _U(16) | code.take(place, mode="clip")
            at[lanes] = place + 1
            ranges.shift(lanes)
            lanes = ranges.due(lanes)
        rows[t] = x
        model.learn(t, x, state)
        one, two = x, one
    ids = rows.T.reshape(-1)[:size]
    if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != crc:
        raise ValueError("token block fails its checksum")
    return ids


_tokenizers: dict = {}
CACHE_WORDS = 1_500_000  #: matches a worker remembers
CACHE_BYTES = 8_000_000  #: and the bytes of those over 15 bytes


_PART = b"\xff"  #: in no text, as no UTF-8 has it
_GROUP = 128  #: matches that go to the library as one


@cache
def _byte_letters() -> np.ndarray:
    """The character that byte-level BPE has for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u2")
    out[seen] = seen
    out[[b for b in range(256) if b not in seen]] = 256 + np.arange(256 - len(seen))
    return out


class _Library:
    """Encodes slices of texts by the tokenizers library, with a bounded table of the matches it has seen.

    The matches are cut already, so the library's BPE gets them without its own search for them: many in a row, parted by a byte that
    no merge has, which the BPE leaves alone. A tokenizer of another kind gets each match by itself. The library cuts the strings
    of its added tokens out of a text before it looks for matches, so texts that hold one are given to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(worker_file(path))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare = Tokenizer(self.tokenizer.model) if self._parted() else None
        self.seen = SeenMatches(self.encode)

    def _parted(self) -> bool:
        """Whether ids are those of a plain byte-level BPE, and no merge has ``_PART``."""
        kind = json.loads(self.tokenizer.to_str())
        model, cut = kind["model"], kind["pre_tokenizer"] or {}
        part = chr(_byte_letters()[_PART[0]])
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        plain = kind["normalizer"] is None and model.get("type") == "BPE" and not any(model.get(k) for k in odd)
        plain = plain and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
        return plain and part in model["vocab"] and not any(part in "".join(m) for m in model["merges"])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches one after another, and how many each has."""
        if self.bare is None:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded))
        groups = [np.frombuffer(_PART.join([*words[k : k + _GROUP], b""]), np.uint8) for k in range(0, len(words), _GROUP)]
        texts = [_byte_letters()[g].tobytes().decode("utf-16-le") for g in groups]
        coded = self.bare.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in coded])
        part = ids == ids[-1]
        return ids[~part], np.diff(np.flatnonzero(part), prepend=-1) - 1

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.seen.encode_slice(data, offsets, CACHE_WORDS, CACHE_BYTES)

    def slice(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and each text's bounds in them."""
        data, offsets = column_bytes(text)
        raw = data.tobytes()
        if not any(t in raw for t in self.added):
            return self._plain(data, offsets)
        ends = offsets.tolist()
        odd = [i for i in range(len(text)) if any(t in raw[ends[i] : ends[i + 1]] for t in self.added)]
        held = np.zeros(len(text), bool)
        held[odd] = True
        plain = pa.array(np.where(held, None, np.array(text.to_pylist(), object)), pa.string())
        ids, bounds = self._plain(*column_bytes(plain))
        pieces = np.split(ids, bounds[1:-1])
        for i in odd:
            pieces[i] = np.array(self.tokenizer.encode(text[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


def _library(path: str) -> _Library:
    if path not in _tokenizers:
        _tokenizers[path] = _Library(path)
    return _tokenizers[path]


_FILE_NAMES = ["part", "block", "start", "first_doc", "doc_ids", "ends", "payload"]
_FILE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
_FILE_SCHEMA = "part int, block long, start long, first_doc long, doc_ids array<long>, ends array<long>, payload binary"


def write_token_file(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Writes the ids of all documents, each with the end id, in ascending doc_id order."""
    # the second and third keys deal the rows of one id (or of none) to several tasks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("k"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "h", "k").sortWithinPartitions("doc_id", "h", "k")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(tokenizer_path)
        part, block, start, number = 0, 0, 0, 0
        waiting: list[np.ndarray] = []  # ids that no block has taken
        open_docs: deque[list] = deque()  # [number, doc_id, ids that no block has taken]
        held = 0

        def take() -> pa.RecordBatch:
            nonlocal block, start, held, waiting
            ids = np.concatenate(waiting)
            waiting, ids = [ids[BLOCK:]], ids[:BLOCK]
            held -= len(ids)
            names, ends, left, first = [], [], len(ids), open_docs[0][0]
            while left:
                d = open_docs[0]
                size = min(left, d[2])
                d[2] -= size
                left -= size
                names.append(d[1])
                ends.append(len(ids) - left)
                if not d[2]:
                    open_docs.popleft()
            row = (part, block, start, first, names, ends, encode_block(ids))
            block += 1
            start += len(ids)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _FILE_TYPES, strict=True)], names=_FILE_NAMES)

        for batch in batches:
            for piece in slices(batch):
                part = piece.column(2)[0].as_py()
                ids, bounds = library.slice(piece.column(1))
                size = np.diff(bounds)
                full = np.full(len(ids) + len(size), END_ID, np.uint32)
                own = np.ones(len(full), bool)
                own[bounds[1:] + np.arange(len(size))] = False
                full[own] = ids
                waiting.append(full)
                held += len(full)
                for doc_id, k in zip(piece.column(0).to_pylist(), size.tolist(), strict=True):
                    open_docs.append([number, doc_id, k + 1])
                    number += 1
                while held >= BLOCK:
                    yield take()
        while held:
            yield take()

    rows.mapInArrow(run, _FILE_SCHEMA).write.mode("overwrite").parquet(path)


def _advance(crc: int, n_bytes: int) -> int:
    """The CRC-32 register after ``n_bytes`` zero bytes, by squaring the one-bit step's matrix."""

    def times(m: list[int], v: int) -> int:
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= m[k]
            v >>= 1
            k += 1
        return out

    matrix = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    bits = n_bytes * 8
    while bits:
        if bits & 1:
            crc = times(matrix, crc)
        matrix = [times(matrix, m) for m in matrix]
        bits >>= 1
    return crc


def combine_crc(one: int, two: int, n_bytes: int) -> int:
    """CRC-32 of a + b from those of a and b, b having ``n_bytes`` bytes."""
    return _advance(one, n_bytes) ^ two


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the decoded blocks."""
    blocks = spark.read.schema(_FILE_SCHEMA).parquet(path)
    offsets = blocks.groupBy("part").agg(F.max(F.col("start") + F.element_at("ends", -1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, begin, out = decode_block(row["payload"]).astype("<u4").tobytes(), 0, []
                for k, (doc_id, end) in enumerate(zip(row["doc_ids"], row["ends"], strict=True)):
                    out.append((row["part"], row["first_doc"] + k, doc_id, row["start"] + begin, end - begin, zlib.crc32(raw[4 * begin : 4 * end])))
                    begin = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] + [pa.int64()] * 5, strict=True)],
                    names=["part", "doc", "doc_id", "start", "n", "crc"],
                )

    pieces = blocks.mapInArrow(run, "part int, doc long, doc_id long, start long, n long, crc long")
    whole = pieces.groupBy("part", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("p")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(4).to_pylist():
                crc = p[0]["crc"]
                for x in p[1:]:
                    crc = combine_crc(crc, x["crc"], 4 * x["n"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    done = whole.select("part", "doc_id", "start", "n_tokens", "p").mapInArrow(join, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return done.join(offsets, "part").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the token file of ``docs`` to the shared folder and reads it back."""
    scratch = Scratch(docs.sparkSession, "ids")
    write_token_file(docs, tokenizer_path, f"{scratch.path}/tokens")
    return read_token_file(docs.sparkSession, f"{scratch.path}/tokens")
