"""Near-duplicate documents by order MinHash.

The k-mers of a text are its windows of five words, each labelled with its occurrence number. Each of
``TABLES`` hash functions picks the ``PICKED`` least labelled k-mers and keeps them in text order; equal
sketches put two texts in one bucket. Unlike plain MinHash a sketch changes when the order does, so it
follows edit similarity. A pair is verified by alignment of the two labelled k-mer sequences: the longest common subsequence
L inside the diagonal band that a similarity of ``SIMILARITY`` allows, and L / (n + m - L) >= ``SIMILARITY``.

Members of a bucket are first compared with its leader (the text whose sketches are shared most) and the links
joined into classes. A bucket all of one class is done. In the others every pair of texts of different classes is a
candidate. Small buckets are paired: the members outside the bucket's largest class with all of its members, if they share
``AGREED`` of the ``TABLES`` sketches, seen from 16-bit marks that members carry. The texts of buckets that would take over
``PAIRED`` squared comparisons are paired by a prefix filter: two similar texts share one of the rarest
n - ceil(0.8 n) + 1 labelled k-mers of each, rarity counted among these texts; so what all texts of a large family have in
common pairs none of them. A pair goes unseen only when its texts are in one class already. Candidates are verified; the links
join texts into classes (connected components), exact copies with them.

Texts of at most ``SHORT`` k-mers have no sketches but an exact way: two similar texts share one of the rarest
n - ceil(0.8 n) + 1 labelled k-mers of each (a prefix filter), and buckets by those need no agreement of sketches.

A pair of longer texts shares fewer than ``AGREED`` sketches with a probability that depends on the length: at
most 1.5e-3 at 41 k-mers, 1.1e-3 at 80 and 8.2e-4 at 1000, all at the least similarity that is a link.

Defined results for odd input: texts that are equal byte for byte, empty ones too, are copies; a null text is a
class of its own; texts without a word have no near links; texts under five words have one k-mer of all their
words; a class's id is its least non-null doc_id (null if it has none); repeated rows get the same class;
an empty table gives an empty result; other columns are ignored by ``classes`` and passed on by ``keep_one``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, map_slices
from siftwell.llm.components import components
from siftwell.llm.textcodes import Words, column_bytes, mix64, occurrence, slices, windows

WIDTH = 5
SIMILARITY = 0.8
TABLES = 30
PICKED = 5
COUNTERS = 17  #: bits of the number of counters that tell rare k-mers from common ones
ADDERS = 8
CARRIED = 400  #: k-mers of a text that carries its prefix
PAIRED = 64  #: buckets of more comparisons than its square are paired by rare k-mers
AGREED = 3
SHORT = 40  #: texts of at most so many k-mers have prefix keys only; none longer than SHORT / SIMILARITY can be similar to them

_U = np.uint64
_ODD = mix64(np.arange(1, TABLES + 1, dtype=np.uint64)) | _U(1)
_PLACE = mix64(np.arange(101, 101 + PICKED, dtype=np.uint64)) | _U(1)
_SALT = mix64(np.arange(1001, 1001 + TABLES, dtype=np.uint64))
_BLOCK = 1 << 16


def labelled(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer codes of each text of a slice, and the texts' bounds in them."""
    words = Words(*column_bytes(text))
    codes, bounds = windows(words.hashes(), words.bounds, WIDTH)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return mix64(codes + occurrence(codes, doc).astype(np.uint64) * _U(0x9E3779B97F4A7C15)), bounds


def sketch_keys(codes: np.ndarray) -> np.ndarray:
    """One bucket key per table for the labelled k-mers of a text; none for a text of SHORT k-mers or fewer."""
    n = len(codes)
    if n <= SHORT:
        return np.zeros(0, np.uint64)
    if n <= _BLOCK:
        at = np.sort(np.argpartition(codes[None, :] * _ODD[:, None], PICKED - 1, axis=1)[:, :PICKED], axis=1)
    else:
        # the least of a long text are among the least of its blocks
        parts = []
        for a in range(0, n, _BLOCK):
            c = codes[a : a + _BLOCK]
            k = min(PICKED, len(c))
            parts.append(a + np.argpartition(c[None, :] * _ODD[:, None], k - 1, axis=1)[:, :k])
        few = np.concatenate(parts, axis=1)
        order = np.argpartition(codes[few] * _ODD[:, None], PICKED - 1, axis=1)[:, :PICKED]
        at = np.sort(np.take_along_axis(few, order, axis=1), axis=1)
    return mix64((codes[at] * _PLACE[: at.shape[1]]).sum(1, dtype=np.uint64) + _SALT)


def band(n: int, m: int) -> int:
    """How far apart two aligned places can be when n and m k-mers reach SIMILARITY."""
    return int((n + m) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9)


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """L / (n + m - L) for the longest common subsequence L of two labelled sequences inside the band; 0 when out of reach."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = SIMILARITY / (1 + SIMILARITY) * (n + m)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need - 1e-9:
        return 0.0
    near = np.abs(i - j) <= band(n, m)
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    else:
        common = len(j)
    return common / (n + m - common)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, keys, grams): the text's 128-bit digest, its number of k-mers, its bucket keys and, of a text
    short enough for a prefix, its labelled k-mers. Null texts are left out."""

    def lists(rows: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codes, bounds = labelled(part.column(1))
        at = bounds.tolist()
        own = [codes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        grams = [c if len(c) <= SHORT / SIMILARITY else c[:0] for c in own]
        return pa.RecordBatch.from_arrays(
            [part.column(0).cast(pa.int64()), part.column(2), pa.array(np.diff(bounds)), lists([sketch_keys(c) for c in own]), lists(grams)],
            names=["doc_id", "node", "n", "keys", "grams"],
        )

    rows = docs.where("text IS NOT NULL").select("doc_id", "text", digest().alias("node"))
    return map_slices(rows, run, "doc_id long, node binary, n long, keys array<long>, grams array<long>")


def prefixes(nodes: DataFrame) -> DataFrame:
    """(node, n, marks, t, key) of the rarest labelled k-mers of short texts, n - ceil(SIMILARITY * n) + 1 of each; those of one text only are left out."""
    grams = nodes.select("node", "n", F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    # a k-mer of one text only sorts first and takes its place in the prefix, but nothing can be found by it
    per = grams.join(counts, "gram").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("own"))
    length = F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1
    left = F.greatest(F.lit(0).cast("long"), length - (F.col("n") - F.size("own"))).cast("int")
    first = F.explode(F.slice("own", F.lit(1), left)).alias("x")
    none = F.array().cast("array<smallint>").alias("marks")
    return per.select("node", "n", none, F.lit(-1).alias("t"), first).select("node", "n", "marks", "t", F.xxhash64("x.gram", F.lit("prefix")).alias("key"))


def digest():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``pairs`` whose texts (node, text) align."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        a, at = labelled(part.column(2))
        b, bt = labelled(part.column(3))
        ok = [aligned(a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]]) >= SIMILARITY for i in range(part.num_rows)]
        return part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    one, two = texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), texts.select(F.col("node").alias("v"), F.col("text").alias("tv"))
    rows = pairs.join(one, "u").join(two, "v").select("u", "v", "tu", "tv")
    return map_slices(rows, run, "u binary, v binary", text="tu")


def _ordered(a: str, b: str):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _agreeing(a: str, b: str):
    """Numbers of the tables in which two arrays of marks are equal."""
    return F.filter(F.transform(F.zip_with(a, b, lambda x, y: x == y), lambda same, i: F.when(same, i)), lambda i: i.isNotNull())


def near_links(nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): verified links between different texts. ``nodes``: (node, n, keys, grams), one row per text."""
    marks = F.transform("keys", lambda k: (F.shiftrightunsigned(k, 48) - 32768).cast("smallint"))
    members = nodes.select("node", "n", marks.alias("marks"), F.posexplode("keys").alias("t", "key"))
    members = members.unionByName(prefixes(nodes))
    shared = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = scratch.save(members.join(shared, "key"), "members")
    weight = members.groupBy("node").agg(F.sum("c").alias("w"))
    members = scratch.save(members.join(weight, "node").select("key", "t", "node", "n", "w", "marks"), "round0")
    scratch.drop("members")
    wanted = members.select("node").distinct()
    texts = docs.where("text IS NOT NULL").select(digest().alias("node"), "text").join(wanted, "node", "left_semi")
    texts = scratch.save(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    prefix = F.col("t") < 0
    close = F.least("n", "ln") >= SIMILARITY * F.greatest("n", "ln") - 1e-9
    similar = close & (prefix | (F.size(_agreeing("marks", "lmarks")) >= AGREED))
    found = scratch.save(verify(_led(members).where(similar).select(*_ordered("node", "leader")).distinct(), texts), "links0")
    mixed = scratch.save(_mixed(members, found, scratch), "mixed")
    scratch.drop("round0")
    small = (F.col("c") - F.col("most")) * F.col("c") <= PAIRED * PAIRED
    # small buckets: pairs of different classes, those outside a bucket's largest class against all its members
    others = mixed.where(small & (F.col("root") != F.col("big")))
    whole = mixed.where(small).select("key", F.col("node").alias("leader"), F.col("n").alias("ln"), F.col("marks").alias("lmarks"), F.col("root").alias("lroot"))
    once = (F.col("root") != F.col("lroot")) & ((F.col("lroot") == F.col("big")) | (F.col("node") < F.col("leader")))
    # of all buckets that a pair shares, only the first two in table order give it: one may come from marks that are equal by chance
    first = prefix | F.array_contains(F.slice(_agreeing("marks", "lmarks"), 1, 2), F.col("t"))
    tries = others.join(whole, "key").where(once).where(similar & first).select(*_ordered("node", "leader"))
    large = mixed.where(~small).groupBy("node", "root").agg(F.bool_or(F.col("root") != F.col("big")).alias("other"))
    rare = _rare_pairs(large, texts, scratch).select(*_ordered("node", "leader"))
    return found.unionByName(scratch.save(verify(tries.unionByName(rare).distinct(), texts), "links"))


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> _U(64 - COUNTERS)).astype(np.int64)


def _rarity(texts: DataFrame) -> np.ndarray:
    """How many labelled k-mers of ``texts`` (text) fall to each of a fixed number of counters: an order for prefixes, and at least each one's own count.

    Each task packs its counters into one row, a few tasks add the rows up, and their sums reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(_slot(labelled(part.column(0))[0]), minlength=len(total))
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += unpacked(raw)
        yield packed(total)

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["c"])

    def unpacked(raw: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(raw), np.int64)

    sums = texts.select("text").mapInArrow(count, "c binary").repartition(ADDERS).mapInArrow(add, "c binary")
    return sum((unpacked(r["c"]) for r in sums.collect()), np.zeros(1 << COUNTERS, np.int64))


def _rare_pairs(nodes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, leader): pairs of ``nodes`` (node, root, other) of different classes that share a k-mer of both prefixes, one of them ``other``.

    Only k-mers that several classes have in a prefix pair texts. Of the common k-mers of two texts all but those in both
    prefixes lie behind the prefix that ends first; texts of up to ``CARRIED`` k-mers carry their prefix, so that pairs
    which can't reach the similarity by this count are left out, and each pair comes once.
    """

    own = scratch.save(texts.join(nodes, "node").select("node", "text", "root", "other"), "large")
    counts = own.sparkSession.sparkContext.broadcast(_rarity(own))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codes, bounds = labelled(part.column(1))
        often = counts.value[_slot(codes)]
        at, keys = bounds.tolist(), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = b - a
            rarest = np.lexsort((codes[a:b], often[a:b]))[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]
            keys.append(codes[a:b][rarest[often[a:b][rarest] > 1]])  # what only one text has finds nothing
        offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).view(np.int64)))
        return pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(np.diff(bounds)), lists], names=["node", "root", "other", "n", "held"])

    rows = scratch.save(map_slices(own, run, "node binary, root binary, other boolean, n long, held array<long>"), "rare")
    keys = rows.select("root", "node", "n", "other", F.explode("held").alias("key"))
    few = rows.where(F.col("n") <= CARRIED).select("node", "held")
    several = keys.groupBy("key").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("key")
    keys = keys.join(several, "key").join(few, "node", "left")
    two = keys.select("key", *[F.col(c).alias(f"l{c}") for c in ("root", "node", "n", "other", "held")])
    close = F.least("n", "ln") >= SIMILARITY * F.greatest("n", "ln") - 1e-9
    common = F.array_intersect("held", "lheld")
    behind = F.ceil(SIMILARITY * F.greatest("n", "ln") - 1e-9) - 1
    enough = F.size(common) + behind >= SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("ln")) - 1e-9
    first = F.when(common.isNull(), True).otherwise((F.array_min(common) == F.col("key")) & enough)
    apart = (F.col("root") != F.col("lroot")) & (~F.col("lother") | (F.col("node") < F.col("lnode")))
    pairs = keys.where("other").join(two, "key").where(apart & close & first)
    return pairs.select("node", F.col("lnode").alias("leader"))


def _led(members: DataFrame) -> DataFrame:
    """Members beside the leader of their bucket, the member whose sketches are shared most."""
    leaders = members.groupBy("key").agg(F.max(F.struct("w", "node", "n", "marks")).alias("x"))
    leaders = leaders.select("key", F.col("x.node").alias("leader"), F.col("x.n").alias("ln"), F.col("x.marks").alias("lmarks"))
    return members.join(leaders, "key").where(F.col("node") != F.col("leader"))


def _mixed(members: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The members of buckets with more than one class, with their class ``root``, the bucket's largest class ``big``, its size ``most`` and the bucket's ``c``."""
    roots = scratch.save(components(links, scratch), "classes")
    members = members.select("key", "t", "node", "n", "marks").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("key").agg(F.sum("m").alias("c"), F.max(F.struct("m", "root")).alias("x"), F.count("*").alias("classes"))
    sizes = sizes.where("classes > 1").select("key", "c", F.col("x.m").alias("most"), F.col("x.root").alias("big"))
    return members.join(sizes, "key")


def _class_table(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(signature rows, (node, root, class_id)) of the texts of ``docs``."""
    sigs = scratch.save(signatures(docs), "signatures")
    nodes = sigs.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("grams").alias("grams"))
    links = near_links(nodes.select("node", "n", "keys", "grams"), docs, scratch)
    roots = components(links, scratch)
    least = sigs.groupBy("node").agg(F.min("doc_id").alias("least"))
    of = least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    of = scratch.save(of, "roots")
    ids = of.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("x"))
    ids = ids.select("root", F.col("x.least").alias("class_id"), F.col("x.node").alias("keeper"))
    return sigs, of.join(ids, "root").select("node", "class_id", "keeper")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept): the class of every row; ``kept`` marks the document that stays."""
    sigs, table = _class_table(docs, Scratch(docs.sparkSession, "omh"))
    rows = sigs.select("doc_id", "node").join(table, "node")
    kept = (F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    alone = docs.where("text IS NULL").select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return rows.select("doc_id", "class_id", kept.alias("kept")).unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those of which a near or exact copy stays."""
    scratch = Scratch(docs.sparkSession, "omh")
    sigs, table = _class_table(docs, scratch)
    keepers = table.where("node = keeper").select("node", F.col("class_id").alias("keep_id"))
    times = sigs.join(keepers, "node").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("node").agg(
        F.first("keep_id").alias("keep_id"), F.count("*").alias("times")
    )
    names = docs.columns
    rows = docs.where("text IS NOT NULL").select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), digest().alias("node"))
    rows = rows.join(times, "node").where(F.col("row.doc_id").eqNullSafe(F.col("keep_id")))
    once = rows.where("times = 1")
    again = rows.where("times > 1").groupBy("node").agg(F.first("row").alias("row"))
    rows = once.select("row").unionByName(again.select("row")).select("row.*")
    return rows.unionByName(docs.where("text IS NULL"))
