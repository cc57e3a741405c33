"""Product-quantised vector codes from integer Lloyd rounds, assigned with Yinyang bounds.

A vector's components become integers floor(1024 x) and are cut into four equal consecutive parts; each part position has a
codebook of up to ``ENTRIES`` entries, at first the parts of the least vec_ids. A round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and then puts the floored mean of its parts in each entry's place.

The entries of a codebook are clustered once into ``GROUPS`` groups. Every part keeps an upper bound of the distance to its entry and
one lower bound for each group of the distance to any other entry in it. When entries move, the bounds follow by the entry's and by the group's
largest drift. Only groups whose lower bound doesn't exceed the upper one are scanned. Distances are compared in double precision
within their error; all entries in that margin are compared again in integers, so ties and near ties come out exactly.

A round is one pass: tasks write the rows with new bounds, and beside them their sums for each entry; Spark adds these up, and the
new codebooks (``ENTRIES`` times the dimensions at most) go back to the tasks. Bounds are rounded outwards to single precision.

Defined results for odd input: vectors that are null or hold null or non-finite components are left out; shorter vectors count as
padded with zeros to the greatest length, and that to a multiple of four; components so large that a sum of squares could
exceed a long count as the bound (131072 at 64 dimensions); equal vec_ids are ordered by vector, null ones come last; a
label's error that exceeds a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUPS = 12
ROWS = 2048  #: vectors whose distances a task holds at a time


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec): the integer vectors of equal length, a multiple of four."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = embeddings.where(x.isNotNull() & ~odd).select("vec_id", "label", "embedding")
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    width = -(-longest // PARTS) * PARTS
    most = float(math.isqrt((1 << 62) // max(width, 1)) // 2)
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(most)), F.lit(-most))).cast("int"))
    return kept.select("vec_id", "label", F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size(x))).alias("vec"))


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries from evenly spaced ones."""
    x = entries.astype(np.float64)
    n = min(GROUPS, len(x))
    centers = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(5):
        of = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.stack([x[of == g].mean(0) if (of == g).any() else centers[g] for g in range(n)])
    return of


def down(x: np.ndarray) -> np.ndarray:
    """Single precision, not above ``x``."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def up(x: np.ndarray) -> np.ndarray:
    """Single precision, not below ``x``."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


class Part:
    """Assignment of one part position's vectors to its codebook."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.real = entries, entries.astype(np.float64)
        self.norms = (self.real**2).sum(1)
        self.members = [np.flatnonzero(group == g) for g in range(GROUPS)]
        self.group = group
        self.scanned = 0  #: distances computed
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((self.real - before.astype(np.float64)) ** 2).sum(1))
        self.moved = moved * (1 + 1e-9)
        self.drift = np.array([self.moved[m].max() if len(m) else 0.0 for m in self.members])

    def exact(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Squared distances to one entry each, in integers."""
        return ((x - self.entries[entry]) ** 2).sum(1)

    def _margin(self, x: np.ndarray) -> float:
        """The most that a squared distance of doubles may be off; 0 while all sums are whole numbers that a double holds."""
        most = float(max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0)))
        total = 4 * x.shape[1] * most * most
        return 0.0 if total < 2**53 else total * x.shape[1] * 2**-50

    def _nearest(self, x: np.ndarray, d: np.ndarray, margin: float) -> np.ndarray:
        """The lowest of the nearest entries, by ``d`` (infinite where not scanned) and by integers within the margin."""
        near = d <= d.min(1)[:, None] + 2 * margin
        best = near.argmax(1)
        if margin:
            tied = np.flatnonzero(near.sum(1) > 1)
            row, entry = np.nonzero(near[tied])
            whole = np.full((len(tied), d.shape[1]), np.iinfo(np.int64).max)
            whole[row, entry] = self.exact(x[tied[row]], entry)
            best[tied] = whole.argmin(1)
        return best

    def _bounds(self, d: np.ndarray, best: np.ndarray, margin: float) -> np.ndarray:
        """For each group the least distance in ``d`` to an entry other than ``best``; overwrites ``d`` there."""
        d[np.arange(len(d)), best] = np.inf
        least = np.stack([d[:, m].min(1) if len(m) else np.full(len(d), np.inf) for m in self.members], axis=1)
        return np.sqrt(np.maximum(least - margin, 0))

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, upper bound, lower bounds) from all distances."""
        real, margin = x.astype(np.float64), self._margin(x)
        d = (real**2).sum(1)[:, None] - 2 * real @ self.real.T + self.norms
        self.scanned += d.size
        best = self._nearest(x, d, margin)
        return best, up(np.sqrt(self.exact(x, best).astype(np.float64)) * (1 + 1e-12)), down(self._bounds(d, best, margin) * (1 - 1e-12))

    def again(self, x: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after the entries have moved; scans only what the bounds leave open."""
        best = best.copy()
        upper = upper.astype(np.float64) + self.moved[best]
        lower = lower.astype(np.float64) - self.drift
        at = np.flatnonzero(lower.min(1) <= upper)
        upper[at] = np.sqrt(self.exact(x[at], best[at]).astype(np.float64)) * (1 + 1e-12)
        self.scanned += len(at)
        at = at[lower[at].min(1) <= upper[at]]
        if len(at):
            part, real = x[at], x[at].astype(np.float64)
            margin = self._margin(part)
            own = (real**2).sum(1)
            scan = lower[at] <= upper[at][:, None]
            d = np.full((len(at), len(self.entries)), np.inf)
            for g, m in enumerate(self.members):
                rows = np.flatnonzero(scan[:, g])
                if len(rows) and len(m):
                    d[np.ix_(rows, m)] = own[rows, None] - 2 * real[rows] @ self.real[m].T + self.norms[m]
                    self.scanned += len(rows) * len(m)
            d[np.arange(len(at)), best[at]] = self.exact(part, best[at])
            new = self._nearest(part, d, margin)
            least = self._bounds(d, new, margin)
            lower[at] = np.where(scan, least, np.minimum(lower[at], least))
            upper[at] = np.sqrt(self.exact(part, new).astype(np.float64)) * (1 + 1e-12)
            best[at] = new
        return best, up(upper), down(np.where(lower > 0, lower * (1 - 1e-12), lower * (1 + 1e-12)))


def _parts(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as (row, part, component) integers."""
    column = batch.column(batch.schema.get_field_index("vec"))
    return np.asarray(column.flatten()).astype(np.int64).reshape(batch.num_rows, PARTS, width)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    size = rows[0].nbytes if len(rows) else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def _held(batch: pa.RecordBatch, name: str, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), kind).reshape(batch.num_rows, *shape)


class Assigner:
    """Assigns whole vectors: the four codebooks of a round, and those before it."""

    def __init__(self, books: np.ndarray, groups: np.ndarray, before: np.ndarray | None):
        self.parts = [Part(books[p], groups[p], None if before is None else before[p]) for p in range(PARTS)]

    def run(self, x: np.ndarray, entry: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(entries as bytes, bounds (row, part, 1 + groups): the upper and the lower ones)."""
        out, held = np.empty((len(x), PARTS), np.uint8), np.empty((len(x), PARTS, 1 + GROUPS), np.float32)
        for p, part in enumerate(self.parts):
            if entry is None:
                best, upper, lower = part.first(x[:, p])
            else:
                best, upper, lower = part.again(x[:, p], entry[:, p].astype(np.int64), bounds[:, p, 0], bounds[:, p, 1:])
            out[:, p], held[:, p, 0], held[:, p, 1:] = best, upper, lower
        return out, held


_STATE = "vec array<int>, entry binary, bounds binary, part int, book int, n long, sums array<long>"


def _round(rows: DataFrame, books: np.ndarray, groups: np.ndarray, before: np.ndarray | None, scratch: Scratch, name: str) -> tuple[DataFrame, np.ndarray]:
    """The rows with their entries and bounds, and the codebooks that follow from them."""
    width = books.shape[2]
    sent = rows.sparkSession.sparkContext.broadcast((books, groups, before))  # ENTRIES times the dimensions, three times
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    first = "entry" not in kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(*sent.value)
        k = books.shape[1]
        sums, count = np.zeros((PARTS, k * width), np.int64), np.zeros((PARTS, k), np.int64)
        batch = None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _parts(batch, width)
                held = (None, None) if first else (_held(batch, "entry", np.uint8, (PARTS,)), _held(batch, "bounds", np.float32, (PARTS, 1 + GROUPS)))
                entry, bounds = assigner.run(x, *held)
                for p in range(PARTS):
                    count[p] += np.bincount(entry[:, p], minlength=k)
                    cell = (entry[:, p].astype(np.int64)[:, None] * width + np.arange(width)).ravel()
                    sums[p] += np.bincount(cell, x[:, p].ravel(), k * width).astype(np.int64)
                own = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label", "vec")]
                yield packed(batch, [*own, _binary(entry), _binary(bounds)], [None] * 4)
        if batch is not None:
            p, e = np.nonzero(count)
            total = sums.reshape(PARTS, k, width)[p, e]
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * width)
            totals = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))]
            yield packed(batch, [None] * 5, totals)

    def packed(like: pa.RecordBatch, row: list, totals: list) -> pa.RecordBatch:
        n = len(next(c for c in [*row, *totals] if c is not None))
        ids, labels = (like.schema.field(c).type for c in ("vec_id", "label"))
        names = ["vec_id", "label", "vec", "entry", "bounds", "part", "book", "n", "sums"]
        types = [ids, labels, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        columns = [pa.nulls(n, t) if c is None else c for c, t in zip([*row, *totals], types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    state = scratch.save(rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, {_STATE}"), name)
    sums = state.where(F.col("part").isNotNull()).select("part", "book", "n", F.posexplode("sums").alias("at", "x"))
    sums = sums.groupBy("part", "book", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    new = books.copy()
    for r in sums.collect():  # ENTRIES times the dimensions at most
        new[r["part"], r["book"], r["at"]] = r["x"] // r["n"]
    sent.destroy()
    return state.where(F.col("part").isNull()).select("vec_id", "label", "vec", "entry", "bounds"), new


def _final(rows: DataFrame, books: np.ndarray, groups: np.ndarray, before: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) by the final codebooks."""
    width = books.shape[2]
    sent = rows.sparkSession.sparkContext.broadcast((books, groups, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _parts(batch, width)
                entry, _ = assigner.run(x, _held(batch, "entry", np.uint8, (PARTS,)), _held(batch, "bounds", np.float32, (PARTS, 1 + GROUPS)))
                error = sum(assigner.parts[p].exact(x[:, p], entry[:, p]) for p in range(PARTS))
                code = pa.array([bytes(e).hex() for e in entry], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(embeddings: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks by part, entry and component)."""
    rows = scratch.save(integer_vectors(embeddings), "vectors")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").collect()
    books = np.array([r["vec"] for r in start], np.int64).reshape(len(start), PARTS, -1 if start and start[0]["vec"] else 0).transpose(1, 0, 2).copy()
    if not len(start):
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    groups, before = np.stack([grouped(b) for b in books]), None
    for k in range(ROUNDS):
        new_rows, new = _round(rows, books, groups, before, scratch, f"round{k}")
        scratch.drop(f"round{k - 1}" if k else "vectors")
        rows, before, books = new_rows, books, new
    codes = scratch.save(_final(rows, books, groups, before), "codes")
    scratch.drop(f"round{ROUNDS - 1}")
    return codes, books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept."""
    codes, books = compress(embeddings, Scratch(embeddings.sparkSession, "yinyang"))
    of = codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    rows = codes.join(of, F.col("label").eqNullSafe(F.col("of")), "left")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
