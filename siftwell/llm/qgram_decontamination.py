"""Benchmark decontamination by the q-gram lemma.

Benchmark texts are cut into fragments of ``FRAGMENT`` characters at every ``STRIDE`` (shorter texts are one
fragment), so every quote of ``FRAGMENT + STRIDE - 1`` characters or more holds a fragment. A passage within k edits of a
fragment of m characters shares at least m + 1 - q - k * q of its q-grams, all on diagonals at most k away from the
passage's own. So shared q-grams are counted in diagonal bands that overlap by half; bands that reach the bound are
verified by an alignment inside the band. The edit budget k is ``EDITS`` of m, but small enough for the bound to be 1 at least
(of 13 to 15 characters none may differ). Nothing within the budget is missed, and whole texts are searched.

Letters are lowered and runs of anything but letters, digits and non-ASCII characters become one blank.

The benchmark is a stated query set: tasks cut its distinct texts into fragments, and the distinct fragments are dealt by hash
to blocks of about ``BLOCK_CHARS`` characters, each sent to all tasks, against all rows of the documents; so neither equal rows nor one
very long text makes a block larger. With more than one block, what each finds is written before the next is sent.

A task looks at the hits of a slice in pieces of ``POSTINGS`` postings. Pieces overlap by the reach of a band, so
each band lies within one of them, and memory doesn't grow with how common a q-gram is.

Defined results for odd input: null and empty texts hold nothing; benchmark texts that are null or, when reduced, shorter
than ``Q`` characters are not searched; a benchmark row without an id is searched but not listed; repeated rows are
judged each; an empty benchmark contaminates nothing; other columns are ignored by ``contamination`` and
passed on by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from siftwell.llm.common import Scratch
from siftwell.llm.textcodes import column_bytes, slices

Q = 8
FRAGMENT, STRIDE = 80, 20
EDITS = 0.08
BLOCK_CHARS = 8_000_000  #: characters of fragments sent to the tasks at once
BLOCK_ITEMS = 500_000  #: benchmark rows up to which their ids are sent along
AT_ONCE = 16_384  #: fragments of one index
POSTINGS = 1 << 20  #: postings that a task lists at a time
_BITS = 22
_CLASSES = (8, 16, 32, 64, 1 << 30)  #: fragments are searched by length class, so that short ones don't weaken the count filter

_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[65:91] = _KEEP[97:123] = _KEEP[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[~_KEEP] = 32


def reduce_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the reduced texts of a slice and the texts' bounds in them."""
    kept = _KEEP[data]
    x = _FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    x[after] += 0x20
    keep = kept.copy()
    keep[1:] |= kept[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    keep[starts] = kept[starts]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep & ((data & 0xC0) != 0x80), out=total[1:])
    return np.frombuffer(x[keep].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), total[offsets]


def gram_codes(cp: np.ndarray) -> np.ndarray:
    """A 32-bit code of the q-gram at each place (the last q - 1 places are missing)."""
    n = max(0, len(cp) - Q + 1)
    h = np.zeros(n, np.uint32)
    for k in range(Q):
        h = (h + cp[k : k + n]) * np.uint32(0x9E3779B1 + 2 * k)
        h ^= h >> np.uint32(15)
    return h


def budget(length: np.ndarray) -> np.ndarray:
    """Edits that a fragment may have: never so many that it could lose all its q-grams."""
    return np.minimum((length * EDITS).astype(np.int64), length // Q - 1)


class FragmentIndex:
    """q-grams of the fragments of one length class."""

    def __init__(self, fragments: list[tuple[int, np.ndarray]]):
        self.item = np.array([i for i, _ in fragments], np.int64)
        self.length = np.array([len(f) for _, f in fragments], np.int64)
        self.edits = budget(self.length)
        self.least = self.length + 1 - Q - self.edits * Q
        self.width = 2 * self.edits + 1
        self.text = np.zeros((len(fragments), int(self.length.max())), np.uint32)
        codes, owner, place = [], [], []
        for f, (_, cp) in enumerate(fragments):
            self.text[f, : len(cp)] = cp
            g = gram_codes(cp)
            codes.append(g)
            owner.append(np.full(len(g), f, np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
        codes_, owner_, place_ = map(np.concatenate, (codes, owner, place))
        order = np.argsort(codes_, kind="stable")
        self.owner, self.place = owner_[order], place_[order]
        self.codes, first = np.unique(codes_[order], return_index=True)
        self.first = np.append(first, len(order))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.codes >> np.uint32(32 - _BITS)] = True
        self.span = int((self.length + self.edits).max())
        self.need = int(self.least.min())
        self.reach = int(self.length.max() + 2 * self.width.max())  #: places between the first and the last hit of a band

    def search(self, cp: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) of all verified matches in a slice."""
        none = np.zeros(0, np.int64)
        hit = self.seen[codes >> np.uint32(32 - _BITS)]
        if self.need > 1:
            # only places inside some stretch of the longest span with enough hits can count
            total = np.zeros(len(codes) + 1, np.int32)
            np.cumsum(hit, out=total[1:])
            stop = np.minimum(np.arange(len(codes)) + self.span, len(codes))
            good = np.flatnonzero(total[stop] - total[:-1] >= self.need)
            edge = np.zeros(len(codes) + 1, np.int32)
            edge[good] += 1
            ends = stop[good]
            edge[: len(codes) + 1] -= np.bincount(ends, minlength=len(codes) + 1).astype(np.int32)
            hit &= np.cumsum(edge[:-1]) > 0
        at = np.flatnonzero(hit)
        row = np.searchsorted(self.codes, codes[at])
        row[row == len(self.codes)] = 0
        same = self.codes[row] == codes[at]
        at, row = at[same], row[same]
        doc = np.searchsorted(bounds, at, "right") - 1
        inside = at + Q <= bounds[doc + 1]
        at, row, doc = at[inside], row[inside], doc[inside]
        if not len(at):
            return none, none
        found: list[tuple[np.ndarray, np.ndarray]] = []
        total = np.cumsum(self.first[row + 1] - self.first[row])
        a = 0
        while a < len(at):
            e = int(np.searchsorted(total, (total[a - 1] if a else 0) + POSTINGS, "right"))
            e = max(e, int(np.searchsorted(at, at[a] + 2 * self.reach)))
            found.append(self._matches(at[a:e], row[a:e], doc[a:e], cp, bounds))
            if e >= len(at):
                break
            a = int(np.searchsorted(at, at[e] - self.reach))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _matches(self, at: np.ndarray, row: np.ndarray, doc: np.ndarray, cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) of the verified matches among hits of the codes ``row`` at places ``at``."""
        count = self.first[row + 1] - self.first[row]
        ends = np.cumsum(count)
        posting = np.repeat(self.first[row] - (ends - count), count) + np.arange(ends[-1])
        owner = self.owner[posting].astype(np.int64)
        # bands start at multiples of the fragment's width and are two widths long
        diagonal = np.repeat(at, count) - self.place[posting] + (1 << 20)
        band = diagonal // self.width[owner]
        doc = np.repeat(doc, count)
        # a slice has one document, of any length, or several of 1 MB together
        shift, bits = (26, 0x3FFFFFF) if len(bounds) > 2 else (42, (1 << 42) - 1)
        key = (owner << 42) | (doc << shift if shift < 42 else 0) | band
        keys, n = np.unique(key, return_counts=True)
        # a band's hits are those of its strip and the next; the band before a strip without a neighbour has that strip's alone
        after = np.zeros(len(keys), bool)
        after[:-1] = keys[1:] == keys[:-1] + 1
        both = n + np.where(after, np.append(n[1:], 0), 0)
        alone = ~np.concatenate([[False], after[:-1]])
        least = self.least[keys >> 42]
        keys = np.concatenate([keys[both >= least], keys[alone & (n >= least)] - 1])
        owner = keys >> 42
        doc, band = (keys & ((1 << 42) - 1)) >> shift, keys & bits
        start = band * self.width[owner] - (1 << 20)
        ok = np.zeros(len(keys), bool)
        for a in range(0, len(keys), 2048):
            s = slice(a, a + 2048)
            ok[s] = self._align(owner[s], start[s], bounds[doc[s]], bounds[doc[s] + 1], cp)
        return doc[ok], self.item[owner[ok]]

    def _align(self, owner: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """Whether a fragment lies within its edit budget on the diagonals of its band (free ends in the text)."""
        lengths, k = self.length[owner], self.edits[owner]
        rows, across = int(lengths.max()), int(2 * self.width[owner].max())
        place = start[:, None] + np.arange(across + rows)
        text = np.where((place >= low[:, None]) & (place < high[:, None]), cp[np.clip(place, 0, len(cp) - 1)], np.uint32(0))
        fragment = self.text[owner]
        outside = np.arange(across) >= 2 * self.width[owner][:, None]
        step = np.arange(across, dtype=np.int32)
        d = np.where(outside, 1 << 20, 0).astype(np.int32)
        best = np.full(len(owner), 1 << 20, np.int32)
        for i in range(1, rows + 1):
            a = d + (text[:, i - 1 : i - 1 + across] != fragment[:, i - 1 : i])
            np.minimum(a[:, :-1], d[:, 1:] + 1, out=a[:, :-1])
            d = np.minimum.accumulate(a - step, axis=1) + step
            d[outside] = 1 << 20
            end = lengths == i
            if end.any():
                best[end] = d[end].min(1)
        return best <= k


def cut(cp: np.ndarray) -> list[np.ndarray]:
    """The fragments of a reduced text."""
    cp = cp[:-1] if len(cp) and cp[-1] == 32 else cp
    if len(cp) < Q:
        return []
    starts = list(range(0, max(1, len(cp) - FRAGMENT + 1), STRIDE))
    if len(cp) > FRAGMENT and starts[-1] != len(cp) - FRAGMENT:
        starts.append(len(cp) - FRAGMENT)
    return [cp[s : s + FRAGMENT] for s in starts]


def indexed(fragments: list[tuple[int, np.ndarray]]) -> list[FragmentIndex]:
    """Indexes of (number, fragment), by length class."""
    classes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for number, f in fragments:
        classes.setdefault(int(np.searchsorted(_CLASSES, len(f), "right")), []).append((number, f))
    return [FragmentIndex(own[a : a + AT_ONCE]) for own in classes.values() for a in range(0, len(own), AT_ONCE)]


def build(items: list[tuple[int, str]]) -> list[FragmentIndex]:
    """Indexes of the fragments of (number, text)."""
    reduced = ((number, reduce_texts(*column_bytes(pa.array([text], pa.string())))[0]) for number, text in items)
    return indexed([(number, f) for number, cp in reduced for f in cut(cp)])


def find(indexes: list[FragmentIndex], text: pa.Array) -> list[set[int]]:
    """Numbers of the fragments or items found in each text."""
    cp, bounds = reduce_texts(*column_bytes(text))
    found: list[set[int]] = [set() for _ in range(len(text))]
    codes = gram_codes(cp)
    if len(codes):
        for index in indexes:
            for doc, item in zip(*index.search(cp, bounds, codes), strict=True):
                found[doc].add(int(item))
    return found


def _code_points(fragments: list[str]) -> list[tuple[int, np.ndarray]]:
    return [(k, np.frombuffer(f.encode("utf-32-le"), np.uint32)) for k, f in enumerate(fragments)]


def fragments(texts: DataFrame) -> DataFrame:
    """(tid, fragment): the distinct fragments of each text (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cp, bounds = reduce_texts(*column_bytes(part.column(1)))
                for k, tid in enumerate(part.column(0).to_pylist()):
                    own = list(dict.fromkeys(f.tobytes().decode("utf-32-le") for f in cut(cp[bounds[k] : bounds[k + 1]])))
                    for a in range(0, len(own), 1 << 14):
                        more = own[a : a + (1 << 14)]
                        yield pa.RecordBatch.from_arrays([pa.array([tid] * len(more)), pa.array(more)], names=["tid", "fragment"])

    return texts.select("tid", "text").mapInArrow(run, "tid string, fragment string")


def _found(docs: DataFrame, sent, name: str) -> DataFrame:
    """``docs`` with an array column ``name``: what the sent list says of each fragment that the text holds, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, says = sent.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for whole in slices(batch):
                for a in range(0, whole.num_rows, 1 << 15):
                    part = whole.slice(a, 1 << 15)
                    more = [list(dict.fromkeys(x for k in sorted(s) for x in says[k])) for s in find(indexes, part.column(at))]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(more, pa.list_(pa.int64()))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(LongType()))]))


def _search(docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """``docs`` with an array column ``name`` of the ids of the items found (null for one without an id)."""
    context, none = docs.sparkSession.sparkContext, F.array().cast("array<bigint>")
    scratch, rid = Scratch(docs.sparkSession, "qgram"), name + "_rid"
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text", F.sha2("text", 256).alias("tid"))
    items = rows.select("tid", "item_id").distinct()
    cuts = scratch.save(fragments(rows.select("tid", "text").dropDuplicates(["tid"])), "fragments")
    whole = cuts.agg(F.coalesce(F.sum(F.length("fragment")), F.lit(0)).alias("chars")).first()["chars"]
    if whole <= BLOCK_CHARS and items.limit(BLOCK_ITEMS + 1).count() <= BLOCK_ITEMS:
        ids: dict[str, list[int | None]] = {}
        for r in items.collect():  # BLOCK_ITEMS rows at most
            ids.setdefault(r["tid"], []).append(r["item_id"])
        says: dict[str, list[int | None]] = {}
        for r in cuts.collect():  # BLOCK_CHARS characters at most
            says.setdefault(r["fragment"], []).extend(ids[r["tid"]])
        sent = context.broadcast((indexed(_code_points(list(says))), list(says.values())))
        return _found(docs, sent, name)
    distinct = scratch.save(cuts.select("fragment").distinct().withColumn("fid", F.monotonically_increasing_id()), "distinct")
    whole = distinct.agg(F.sum(F.length("fragment")).alias("chars")).first()["chars"]
    n = -(-whole // BLOCK_CHARS)
    docs = scratch.save(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    hits = None
    for k in range(n):
        # distinct fragments of FRAGMENT characters at most, dealt by hash: about BLOCK_CHARS characters
        block = distinct.where(F.pmod(F.xxhash64("fragment"), F.lit(n)) == k).collect()
        sent = context.broadcast((indexed(_code_points([r["fragment"] for r in block])), [[r["fid"]] for r in block]))
        found = _found(docs.select(rid, "text"), sent, name).where(F.size(name) > 0).drop("text")
        found = scratch.save(found, f"block{k}")
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    of = distinct.join(cuts, "fragment").join(items, "tid").select("fid", "item_id")
    hits = hits.select(rid, F.explode(name).alias("fid")).join(of, "fid").select(rid, "item_id").distinct()
    hits = hits.groupBy(rid).agg(F.transform(F.collect_list(F.struct("item_id")), lambda x: x["item_id"]).alias(name))
    return docs.join(hits, rid, "left").withColumn(name, F.coalesce(name, none)).drop(rid)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) of every row of ``docs``."""
    out = _search(docs.select("doc_id", "text"), benchmark, "found")
    ids = F.array_sort(F.array_distinct(F.array_compact("found")))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.size("found") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage."""
    mark = "found"
    while mark in docs.columns:
        mark += "_"
    return _search(docs, benchmark, mark).where(F.size(mark) == 0).drop(mark)
