"""A feature-hashing text embedding.

Features are lower-cased words, pairs of neighbouring words, and the 3-grams of each word between two marks. Spark has no
BLAKE2b, so they are found and hashed on Arrow batches. The words of a batch are taken in blocks of bounded length, whose
distinct words and pairs are hashed once each; the features themselves are never listed.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

LEAST_DIMENSIONS = 16
HELD = 1 << 20  #: characters of words that are looked at together
_WORD = re.compile("[a-z0-9_]+")
_END = re.compile("[^a-z0-9_]|$")


def places(names: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each feature: the digest's first four bytes, and the lowest bit of its fifth."""
    hashed = hashlib.blake2b
    raw = np.frombuffer(b"".join([hashed(name.encode(), digest_size=8).digest() for name in names]), np.uint8).reshape(-1, 8)
    bucket = np.ascontiguousarray(raw[:, :4]).view(">u4").ravel().astype(np.int64) % dimensions
    return bucket, np.where(raw[:, 4] & 1, 1.0, -1.0)


def _grams(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct 3-grams of words between two marks, the places of all in them, and how many each word has."""
    number: dict[str, int] = {}
    found = array("i")
    for word in words:
        marked = f"^{word}$"
        found.extend([number.setdefault(marked[k : k + 3], len(number)) for k in range(len(word))])
    return list(number), np.array(found, np.int64), np.array([len(w) for w in words], np.int64)


def _pieces(texts: list[str | None], most: int) -> Iterator[tuple[int, str | None, list[str]]]:
    """(row, word before, words) of lower-cased texts; a text of over ``most`` characters is cut after a word."""
    for row, text in enumerate(texts):
        start, before = 0, None
        while start < len(text or ""):
            end = _END.search(text, min(start + most, len(text))).start()
            words = _WORD.findall(text, start, end)
            yield row, before, words
            start, before = max(end, start + 1), words[-1] if words else before


def embed_texts(texts: list[str | None], dimensions: int, most: int = HELD) -> np.ndarray:
    """Unit vectors of lower-cased texts, one a row; zeros for a text without words."""
    out = np.zeros((len(texts), dimensions))
    flat = out.reshape(-1)
    number: dict[str, int] = {}
    names, rows, firsts, seconds, pair_rows, held = [], [], [], [], [], 0

    def add() -> None:
        if not rows:
            return
        distinct = list(number)
        own, of = np.concatenate(rows), np.concatenate(names)
        bucket, sign = places(distinct, dimensions)
        np.add.at(flat, own * dimensions + bucket[of], sign[of])
        grams, which, sizes = _grams(distinct)
        bucket, sign = (x[which] for x in places(grams, dimensions))
        first = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():  # words of one length at once
            some = np.flatnonzero(sizes[of] == size)
            for part in np.array_split(some, max(1, -(-len(some) * size // HELD))):
                at = first[of[part]][:, None] + np.arange(size)
                np.add.at(flat, (own[part][:, None] * dimensions + bucket[at]).ravel(), sign[at].ravel())
        pairs, which = np.unique(np.concatenate(firsts) * len(distinct) + np.concatenate(seconds), return_inverse=True)
        bucket, sign = places([f"{distinct[p // len(distinct)]}_{distinct[p % len(distinct)]}" for p in pairs.tolist()], dimensions)
        np.add.at(flat, np.concatenate(pair_rows) * dimensions + bucket[which], sign[which])

    for row, before, words in _pieces(texts, most):
        if not words:
            continue
        own = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        # a pair's first word may be the last one of the piece before
        linked = own if before is None else np.append(number.setdefault(before, len(number)), own)
        names.append(own)
        rows.append(np.full(len(own), row))
        firsts.append(linked[:-1])
        seconds.append(linked[1:])
        pair_rows.append(np.full(len(linked) - 1, row))
        held += sum(map(len, words))
        if held >= most:
            add()
            number, held = {}, 0
            for part in (names, rows, firsts, seconds, pair_rows):
                part.clear()
    add()
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, size, out=out, where=size > 0)


def hash_embedding(rows: DataFrame, text: str, dimensions: int = 512, name: str = "embedding") -> DataFrame:
    """``rows`` with the unit vector of a text column (a zero vector for a text without words or a null)."""
    n = max(LEAST_DIMENSIONS, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = embed_texts(batch.column(batch.num_columns - 1).to_pylist(), n)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=batch.schema.names)

    made = rows.withColumn(name, F.lower(text))
    schema = StructType([*made.schema.fields[:-1], StructField(name, ArrayType(DoubleType()))])
    return made.mapInArrow(run, schema)
