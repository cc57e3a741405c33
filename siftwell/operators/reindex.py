"""The persistent index of a file table: chunks, symbols, imports and postings that change together.

Every table is dealt to buckets by path. A full index writes all buckets; an incremental one takes the rows of unchanged paths
from the old snapshot, only in the buckets that hold a changed or deleted path, and puts both in force at once.

Postings: for each bucket, field and gram the list of chunks that have it, with the times for words. Fields are ``c`` (trigrams of
the content), ``s`` (of the symbol), ``p`` (of the path) and ``w`` (words of the content). A gram may have several rows in a bucket, each
with other chunks.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.grams import gram_pairs, gram_text, text_slices
from siftwell.functions.imports import imported_modules
from siftwell.operators.ingest import line_windows
from siftwell.sources.scratch import WrittenTables
from siftwell.sources.snapshot import SnapshotStore, bucket_of, by_bucket

FORMAT = 2  #: of the tables below; an index of another format is built anew
HELD = 1 << 21  #: entries of posting lists that a task holds
GIVEN = 1 << 18  #: and of those it gives out at a time
LONG = 1 << 20  #: characters of a long text
WORDS = "[a-z0-9_]+"
FILES_A_BUCKET = 20_000
SHIFT = 32  #: a chunk's number is its bucket, shifted, and its place in the bucket
ORDER = {"chunks": ["path", "start_line"], "symbols": ["path", "line"], "imports": ["src", "module"], "postings": ["field", "gram"]}


def buckets_for(n: int) -> int:
    """Buckets of an index of ``n`` files."""
    return max(8, -(-n // FILES_A_BUCKET))


def chunk_table(files: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, path, start_line, end_line, symbol, content, chunk_hash, n_content, n_symbol) of files (path, content)."""
    rows = files.select(bucket_of(F.col("path"), buckets).alias("bucket"), "path", F.coalesce("content", F.lit("")).alias("content"))
    rows = line_windows(rows, window)
    rows = rows.withColumns({"symbol": F.regexp_extract("content", f"({T.WORD})", 1), "chunk_hash": F.sha2("content", 256)})
    rows = rows.select("bucket", "path", "start_line", "end_line", "symbol", "content", "chunk_hash")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for column in (batch.column(k) for k in (5, 4)):
                counts = [np.bincount(gram_pairs(texts)[0], minlength=len(texts)) for _, texts in text_slices(column)]
                sizes.append(pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sizes], names=[*batch.schema.names, "n_content", "n_symbol"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(sized, f"{kinds}, n_content int, n_symbol int")


def numbered(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunks`` with ``cid``: the bucket and the place in it, by path and line."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("path", "start_line"))
    return by_bucket(chunks, buckets).withColumn("cid", F.shiftleft(F.col("bucket").cast("long"), SHIFT) + place)


def postings(chunks: DataFrame, held: int = HELD) -> DataFrame:
    """(bucket, field, gram, chunks): of numbered chunks; ``chunks`` are (cid, times).

    A task holds about ``held`` entries at a time, whatever the size of a bucket: a gram has a row for each such piece.
    """
    rows = chunks.select("bucket", "cid", "content", "symbol", "path")
    return rows.mapInArrow(lambda batches: posting_batches(batches, held), "bucket int, field string, gram string, chunks array<struct<cid:bigint,times:int>>")


def posting_batches(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Postings of rows (bucket, cid, content, symbol, path), in pieces of one bucket and about ``most`` entries."""
    piece: Postings | None = None
    for batch in batches:
        buckets, cids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        ends = [*(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for start, end in zip([0, *ends[:-1]], ends, strict=True):  # rows of one bucket
            for part, contents in text_slices(batch.column(2).slice(start, end - start)):
                first, n = start + part.start, len(contents)
                if piece and (piece.bucket != buckets[start] or piece.size >= most):
                    yield from piece.batches()
                    piece = None
                piece = piece or Postings(int(buckets[start]))
                piece.add(cids[first : first + n], contents, *(batch.column(k).slice(first, n).to_pylist() for k in (3, 4)))
    if piece:
        yield from piece.batches()


class Postings:
    """Posting lists of some chunks of one bucket, by the chunks' places in it."""

    def __init__(self, bucket: int):
        self.bucket, self.size = bucket, 0
        self.grams: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"c": [], "s": [], "p": []}
        self.names: dict[str, int] = {}
        self.words = array("I"), array("I"), array("I")  # number of the word, chunk, times

    def add(self, cids: np.ndarray, contents: list[str], symbols: list[str], paths: list[str]) -> None:
        places = (cids - (self.bucket << SHIFT)).astype(np.uint32)
        for field, texts in (("c", contents), ("s", symbols), ("p", paths)):
            owner, codes = gram_pairs(texts)
            self.grams[field].append((codes.astype(np.uint16), places[owner]))
            self.size += len(codes)
        number = self.names
        for place, content in zip(places.tolist(), contents, strict=True):
            text = content.lower()
            # of a long text, all words are never listed at once
            found = Counter(re.findall(WORDS, text) if len(text) <= LONG else (m[0] for m in re.finditer(WORDS, text)))
            self.words[0].extend([number.setdefault(w, len(number)) for w in found])
            self.words[1].extend([place] * len(found))
            self.words[2].extend(found.values())
            self.size += len(found)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The lists, a field at a time; what has been given out is no longer held."""
        for field in list(self.grams):
            codes, places = (np.concatenate(x) for x in zip(*self.grams.pop(field), strict=True))
            order = np.argsort(codes, kind="stable")
            sizes = np.bincount(codes, minlength=1)
            found = np.flatnonzero(sizes)
            yield from self._batches(field, [gram_text(g) for g in found.tolist()], sizes[found], order, places)
        word, places, times = (np.frombuffer(x, np.uint32) for x in self.words)
        names, self.names = list(self.names), {}
        yield from self._batches("w", names, np.bincount(word, minlength=len(names)), np.argsort(word, kind="stable"), places, times)

    def _batches(self, field: str, grams: list[str], sizes: np.ndarray, order: np.ndarray, places: np.ndarray, times: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Rows of whole grams, about ``GIVEN`` entries at a time."""
        ends = np.cumsum(sizes)
        start = before = 0
        while start < len(grams):
            stop = min(int(np.searchsorted(ends, before + GIVEN)) + 1, len(grams))
            own = order[before : ends[stop - 1]]
            n = stop - start
            pairs = [pa.array(places[own].astype(np.int64) + (self.bucket << SHIFT)), pa.array(np.ones(len(own), np.int32) if times is None else times[own].astype(np.int32))]
            offsets = np.append(0, ends[start:stop] - before).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(pairs, names=["cid", "times"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.bucket] * n, pa.int32()), pa.array([field] * n, pa.string()), pa.array(grams[start:stop], pa.string()), lists], names=["bucket", "field", "gram", "chunks"]
            )
            start, before = stop, int(ends[stop - 1])


def _tables(chunks: DataFrame, imports: DataFrame, buckets: int) -> dict[str, DataFrame]:
    chunks = WrittenTables(chunks.sparkSession, "chunks").save(numbered(chunks, buckets))
    symbols = chunks.where("symbol <> ''").select("bucket", "path", F.col("symbol").alias("name"), F.col("start_line").alias("line"))
    return {"chunks": chunks, "symbols": symbols, "imports": imports, "postings": postings(chunks)}


def _imports(files: DataFrame, buckets: int) -> DataFrame:
    module = F.explode(imported_modules(T.language_of(F.col("path")), F.col("content")))
    return files.select(bucket_of(F.col("path"), buckets).alias("bucket"), F.col("path").alias("src"), module.alias("module"))


def full_index(store: SnapshotStore, files: DataFrame, window: int = 80) -> str:
    """Indexes all files (path, content) anew."""
    return store.commit(_tables(chunk_table(files, window, store.buckets), _imports(files, store.buckets), store.buckets), order=ORDER)


def incremental_index(store: SnapshotStore, changed: DataFrame, deleted: DataFrame, window: int = 80, versions: DataFrame | None = None) -> str:
    """Indexes changed or new files (path, content) and forgets deleted paths (path); reads and writes only the buckets of these.

    With ``versions`` (path, version), the table ``versions`` follows in the same commit, deleted paths included.
    """
    base = store.manifest()
    gone = changed.select("path").unionByName(deleted.select("path")).distinct()
    touched = sorted(r["bucket"] for r in gone.select(bucket_of(F.col("path"), store.buckets).alias("bucket")).distinct().collect())  # one for each bucket at most
    if not touched:
        return base["version"]
    old = store.read("chunks", touched, base).drop("cid").join(gone, "path", "left_anti")
    new = chunk_table(changed, window, store.buckets)
    kept = store.read("imports", touched, base).join(gone.withColumnRenamed("path", "src"), "src", "left_anti")
    tables = _tables(old.unionByName(new), kept.unionByName(_imports(changed, store.buckets)), len(touched))
    if versions is not None:
        held = store.read("versions", touched, base).join(gone, "path", "left_anti") if "versions" in base["tables"] else None
        new = versions.select("path", "version", bucket_of(F.col("path"), store.buckets).alias("bucket"))
        tables["versions"] = new if held is None else held.select("path", "version", "bucket").unionByName(new)
    return store.commit(tables, touched, base, ORDER)
