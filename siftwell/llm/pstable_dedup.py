"""Near-duplicate vectors by Euclidean p-stable hashing.

A vector of unit length is projected on random normal directions, shifted and cut into cells of one width; the cells of several
projections together are its bucket in one table, and there are several tables. Vectors that share a bucket are compared
exactly: cosine in double precision.

Equal vectors become one with a weight first. The number of distinct vectors sets the hash (``plan``): so many projections and such a
width that a bucket holds about ``COMPANY`` unrelated vectors for each of its own, and so many tables that a pair whose cosine is just
``COSINE`` shares none with a probability of ``MISSED``; closer pairs are missed far less often (at cosine 0.95 under 1e-8 for
50 000 vectors). The tables grow as about the 0.27th power of the vectors.

Buckets over ``BLOCK`` vectors are cut into blocks by hash, and each pair of blocks is one unit of work, so a hot bucket is spread
over many tasks and no task holds more than two blocks. A pair is counted in the first table that both share, which their
bucket lists tell. Of a unit's links only sums for each vector and a spanning forest leave it, never the pairs.

Defined results for odd input: vectors that are null, empty or zero, or that hold null or non-finite components link with nothing and are their
own component; vectors of different lengths never link; each row of equal vectors is another vector (n_links counts it, and rows with
one vec_id are judged alike); null ids take part, are least only where a component has no other, and are kept then; an
empty table gives an empty result; other columns, labels among them, are ignored.
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
from siftwell.llm.components import components

COSINE = 0.9
MISSED = 1e-5
COMPANY = 512
BLOCK = 1024
SEED = 20260101


def same_cell(width: float, distance: float) -> float:
    """The probability that one projection puts two points of that distance into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(n: int) -> tuple[int, float, int]:
    """(projections, width, tables) for ``n`` distinct vectors; unrelated unit vectors are sqrt(2) apart."""
    near, far = math.sqrt(2 - 2 * COSINE), math.sqrt(2)
    share = min(1.0, COMPANY / max(n, 1))
    k = max(1, round(math.log(share) / math.log(same_cell(2.2, far))))
    low, high = 0.01, 64.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if same_cell(mid, far) ** k > share else (mid, high)
    both = same_cell(high, near) ** k
    return k, high, max(1, math.ceil(math.log(MISSED) / math.log1p(-both)))


def _rows(batch: pa.RecordBatch, name: str = "vec") -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    flat, offsets = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets)
    return np.split(flat, (offsets[1:-1] - offsets[0]))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no square overflows."""
    x = vectors / np.abs(vectors).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def valid(column: str = "embedding"):
    """Whether a vector takes part."""
    x = F.col(column)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~odd & F.exists(x, lambda v: v != 0), F.lit(False))


def identified(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec, node): the vectors that take part and a digest of their components."""
    rows = embeddings.where(valid()).select("vec_id", F.col("embedding").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() for v in _rows(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.binary())], names=["vec_id", "vec", "node"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, vec {kinds['vec']}, node binary")


def bucketed(nodes: DataFrame, n: int) -> DataFrame:
    """(node, codes): the bucket of each vector in every table, as a 64-bit code with the table in it."""
    k, width, tables = plan(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            vectors = _rows(batch)
            sizes = np.array([len(v) for v in vectors])
            codes = np.empty((len(vectors), tables), np.int64)
            for size in np.unique(sizes).tolist():
                if size not in by_size:
                    draw = np.random.default_rng([SEED, size])
                    by_size[size] = draw.standard_normal((size, tables * k)), draw.uniform(0, width, tables * k), draw.integers(1, 1 << 62, (tables, k)) * 2 + 1
                direction, shift, mix = by_size[size]
                at = np.flatnonzero(sizes == size)
                cells = np.floor((unit(np.stack([vectors[i] for i in at])) @ direction + shift) / width).astype(np.int64)
                h = (cells.reshape(len(at), tables, k) * mix).sum(2) + mix[:, 0]
                codes[at] = h ^ (h >> 29)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")), lists], names=["node", "codes"])

    return nodes.select("node", "vec").mapInArrow(run, "node binary, codes array<long>")


def units_of_work(codes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, side, node): the vectors of each pair of blocks of each shared bucket; side 0 and 1, or 2 for a block with itself.

    The sizes are written first: then a hot bucket's entries can be split over tasks when they are joined.
    """
    entries = codes.select("node", F.posexplode("codes").alias("t", "code"))
    sizes = entries.groupBy("t", "code").agg(F.count("*").alias("m")).where("m > 1")
    sizes = scratch.save(sizes, "sizes")
    held = entries.join(sizes, ["t", "code"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = held.withColumn("own", own).select("node", "t", "code", "own", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return pairs.select(F.struct("t", "code", low.alias("low"), high.alias("high")).alias("key"), side.cast("int").alias("side"), "node")


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the links (a, b) that join what earlier ones did not."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(i)
    return kept


def linked_within(vectors: list[np.ndarray], codes: np.ndarray, side: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the pairs of a unit of work that reach ``COSINE`` and share no earlier table than ``t``."""
    sizes = np.array([len(v) for v in vectors])
    found = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = unit(np.stack([vectors[i] for i in at]))
        for left in (at_ for at_ in np.array_split(np.arange(len(at)), -(-len(at) // 256)) if len(at_)):
            close = x[left] @ x.T >= COSINE
            # a block with itself: each pair once; two blocks: only pairs across
            inside = side[at[left]][:, None] == 2
            close &= np.where(inside, left[:, None] < np.arange(len(at)), (side[at[left]] == 0)[:, None] & (side[at] == 1))
            p, q = np.nonzero(close)
            found.append((at[left[p]], at[q]))
    a, b = (np.concatenate(z) for z in zip(*found, strict=True))
    fresh = np.ones(len(a), bool)
    for s in range(0, len(a), 1 << 12):
        part = slice(s, s + (1 << 12))
        fresh[part] = ~(codes[a[part], :t] == codes[b[part], :t]).any(1)
    return a[fresh], b[fresh]


def compared(work: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, n): each unit's number of links of a vector, weighted (other null), and links that join its components (n null)."""
    rows = work.join(nodes.select("node", "vec", "codes", "weight"), "node")
    rows = rows.select("key", "side", "node", "vec", "codes", "weight").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit_rows in whole_keys(batches):
            t = unit_rows.column(0).field("t")[0].as_py()
            node = unit_rows.column(2).to_pylist()
            side = np.asarray(unit_rows.column(1))
            codes = np.asarray(unit_rows.column(4).flatten()).reshape(len(node), -1)
            weight = np.asarray(unit_rows.column(5))
            a, b = linked_within(_rows(unit_rows), codes, side, t)
            if not len(a):
                continue
            n = (np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))).astype(np.int64)
            some = np.flatnonzero(n).tolist()
            tree = _forest(a, b)
            ours = [node[i] for i in some] + [node[i] for i in a[tree]]
            others = [None] * len(some) + [node[i] for i in b[tree]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ours, pa.binary()), pa.array(others, pa.binary()), pa.array([*n[some].tolist(), *[None] * len(tree)], pa.int64())], names=["node", "other", "n"]
            )

    return rows.mapInArrow(run, "node binary, other binary, n long")


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each key (column 0, in order) as one batch."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        key = batch.column(0)
        parts = [np.asarray(key.field(c)) for c in ("t", "code", "low", "high")]
        new = np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1 if batch.num_rows > 1 else []
        starts = [0, *map(int, new), batch.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            piece = batch.slice(s, e - s)
            if held and held[0].column(0)[0].as_py() != piece.column(0)[0].as_py():
                yield joined()
                held = []
            held.append(piece)
    if held:
        yield joined()


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    scratch = Scratch(embeddings.sparkSession, "pstable")
    rows = scratch.save(identified(embeddings), "rows")
    nodes = rows.groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    nodes = scratch.save(nodes, "distinct")
    codes = bucketed(nodes, nodes.count())
    nodes = scratch.save(nodes.join(codes, "node"), "nodes")
    found = scratch.save(compared(units_of_work(nodes.select("node", "codes"), scratch), nodes), "found")
    links = found.where(F.col("other").isNotNull()).select(F.col("node").alias("u"), F.col("other").alias("v"))
    roots = scratch.save(components(links, scratch), "roots")
    counts = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("n").alias("n"))
    own = nodes.select("node", "least", "weight").join(roots, "node", "left").join(counts, "node", "left")
    own = own.withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("weight") - 1)
    own = scratch.save(own, "own")
    # written first, so that the rows of a large component can be split over tasks when they are joined
    ids = scratch.save(own.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    own = scratch.save(own.join(ids, "root").select("node", "n_links", "component_id"), "judged")
    judged = rows.select("vec_id", "node").join(own, "node").select("vec_id", "n_links", "component_id")
    alone = embeddings.where(~valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
