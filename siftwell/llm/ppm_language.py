"""Language identification by prediction by partial matching.

Texts are reduced to lower-case letters (bytes of A-Z, a-z and of all non-ASCII characters; Latin-1
capitals lowered too) with one blank for each run of anything else. For each language a context tree over
``ORDER`` preceding bytes is counted once and frozen. A byte's probability is n / (T + q) in the longest
context that has seen it; every longer context charges its escape q / (T + q) (method C, no exclusions);
below order 0 all 256 bytes are equally likely. A text's language is that of the shortest exact code; the
score is that language's posterior under equal priors.

The trees are fitted on a bounded sample: about ``TRAIN_DOCS`` labelled documents of each of the ``LANGUAGES`` most frequent
languages, chosen by a hash of the id. Each order of a tree is counted over the whole sample and keeps about
``nodes_per_language(L)`` nodes, the most frequent first, ties by hash; so every language keeps a tree, however many there are.
Every document is scored whole.

Defined results for odd input: a null text, or one without any Unicode letter, is ``und`` with score 0, as
is every text if nothing could be learned; null languages and null ids are not learned from, and a null id
is not held out; ties go to the first language in code point order; repeated rows are scored each; columns
besides doc_id, text and lang are ignored by ``identify`` and passed on by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, fold, map_slices
from siftwell.llm.textcodes import KeyTable, column_bytes, slices

ORDER = 3
TRAIN_DOCS = 4000
LANGUAGES = 1024  #: learned at most, most frequent first
FOLDS, HELD = 4, 2
UNKNOWN = "und"
MAX_NODES = 1 << 17
MAX_CELLS = 1 << 24  #: of the cost table: leaves of all languages times languages

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[128:] = False
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[~_LETTER] = 32


def nodes_per_language(languages: int) -> int:
    return max(256, min(MAX_NODES, MAX_CELLS // max(1, languages) ** 2))


def normal_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams (context and byte, as uint32) at each byte of the reduced texts, and the texts' bounds in them."""
    letter = _LETTER[data]
    x = _FOLDED[data]
    after_c3 = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after_c3[(data[after_c3] >= 0x80) & (data[after_c3] <= 0x9E) & (data[after_c3] != 0x97)]
    x[capital] += 0x20
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    keep[starts] = letter[starts]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    bounds = total[offsets]
    at = np.arange(bounds[-1]) + ORDER * np.repeat(np.arange(1, len(offsets)), np.diff(bounds))
    padded = np.full(bounds[-1] + ORDER * len(offsets), 32, np.uint32)
    padded[at] = x[keep]
    gram = padded.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= padded[:-k] << np.uint32(8 * k)
    return gram[at], bounds


class ContextTrees:
    """Frozen trees of all languages: code lengths in bits by gram and escapes by context, per order."""

    def __init__(self, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]):
        """``counts``: by language and length (1 to ORDER + 1), grams and how often each occurs."""
        self.languages = sorted(counts)
        n = len(self.languages)
        self.base = np.full((256, n), 8.0)
        self.levels: list[tuple[KeyTable, np.ndarray, KeyTable, np.ndarray]] = []
        for length in range(1, ORDER + 2):
            mask = np.uint32((1 << 8 * length) - 1) if length < 4 else np.uint32(0xFFFFFFFF)
            per = []
            for lang in self.languages:
                keys, count = counts[lang].get(length, (np.zeros(0, np.uint32), np.zeros(0)))
                order = np.argsort(keys)
                per.append((keys[order], count[order]))
            seen = np.unique(np.concatenate([k for k, _ in per]))
            contexts = np.unique(seen >> np.uint32(8))
            escape = np.zeros((len(contexts), n))
            cost = np.empty((len(seen), n))
            where = np.searchsorted(contexts, seen >> np.uint32(8))
            shorter = self._cost(seen & (mask >> np.uint32(8)), length - 1)
            for j, (keys, count) in enumerate(per):
                own = np.searchsorted(contexts, keys >> np.uint32(8))
                total = np.bincount(own, weights=count, minlength=len(contexts))
                distinct = np.bincount(own, minlength=len(contexts))
                known = total > 0
                escape[known, j] = np.log2((total[known] + distinct[known]) / distinct[known])
                cost[:, j] = escape[where, j] + shorter[:, j]
                cost[np.searchsorted(seen, keys), j] = np.log2((total + distinct)[own] / count)
            self.levels.append((KeyTable(seen), cost, KeyTable(contexts), escape))
        self.cost32 = self.levels[-1][1].astype(np.float32)

    def _cost(self, grams: np.ndarray, length: int) -> np.ndarray:
        """Bits of the last byte of each gram of ``length`` bytes, by language."""
        if length == 0:
            return np.full((len(grams), len(self.languages)), 8.0)
        table, cost, contexts, escape = self.levels[length - 1]
        row = table.find(grams)
        out = cost[row]
        lost = np.flatnonzero(row < 0)
        if len(lost):
            g = grams[lost]
            c = contexts.find(g >> np.uint32(8))
            mask = np.uint32((1 << 8 * (length - 1)) - 1)
            out[lost] = np.where((c >= 0)[:, None], escape[c], 0.0) + self._cost(g & mask, length - 1)
        return out

    def bits(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length of each document by language."""
        row = self.levels[-1][0].find(grams)
        cost = self.cost32[row]
        lost = np.flatnonzero(row < 0)
        if len(lost):
            cost[lost] = self._cost(grams[lost], ORDER + 1)
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            out[full] = np.add.reduceat(cost, bounds[full], axis=0, dtype=np.float64)
        return out


def _bin(n: str):
    """Counts in steps: each by itself up to 64, then in steps of an eighth."""
    return F.when(F.col(n) <= 64, F.col(n).cast("double")).otherwise(F.floor(F.log2(n) * 6) + 100)


def train(docs: DataFrame) -> ContextTrees | None:
    """Counts the trees of the languages of ``docs`` (doc_id, text, lang) over the bounded sample."""
    spark = docs.sparkSession
    rows = docs.where((fold("doc_id", FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in sizes.collect()}
    if not sizes:
        return None
    rate = spark.createDataFrame([(k, TRAIN_DOCS / v) for k, v in sizes.items()], "lang string, rate double")
    sample = rows.select("doc_id", "text", "lang").join(F.broadcast(rate), "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams, bounds = normal_grams(*column_bytes(part.column(0)))
                names, code = np.unique(np.array(part.column(1).to_pylist(), object), return_inverse=True)
                key = (np.repeat(code, np.diff(bounds)).astype(np.uint64) << np.uint64(32)) | grams
                keys, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[(keys >> np.uint64(32)).astype(int)], pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

    counted = sample.where(draw < F.col("rate")).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    leaves = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shorter = [F.struct(F.lit(k).alias("len"), F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")) for k in range(1, ORDER + 2)]
    nodes = leaves.select("lang", "n", F.explode(F.array(*shorter)).alias("x")).groupBy("lang", "x.len", "x.gram").agg(F.sum("n").alias("n"))
    scratch = Scratch(spark, "ppm")
    nodes = scratch.save(nodes.withColumn("bin", _bin("n")), "nodes")
    # whole bins of counts from the most frequent down, and of the one that goes over the bound a share by hash
    bound = nodes_per_language(len(sizes))
    steps = nodes.groupBy("lang", "len", "bin").agg(F.count("*").alias("nodes")).collect()  # some 200 bins a language and length
    cuts, held = [], {}
    for r in sorted(steps, key=lambda r: -r["bin"]):
        k = (r["lang"], r["len"])
        before = held.get(k, 0)
        held[k] = before + r["nodes"]
        if before < bound:
            cuts.append((*k, r["bin"], min(1.0, (bound - before) / r["nodes"])))
    keep = spark.createDataFrame(cuts, "lang string, len int, bin double, share double")
    drawn = F.pmod(F.xxhash64("gram", F.lit("node")), F.lit(1 << 20)) / float(1 << 20) < F.col("share")
    found = nodes.join(F.broadcast(keep), ["lang", "len", "bin"]).where(drawn).select("lang", "len", "gram", "n").toArrow()
    scratch.drop("nodes")
    langs, length = np.array(found.column("lang").to_pylist(), object), found.column("len").to_numpy()
    grams, n = found.column("gram").to_numpy().astype(np.uint32), found.column("n").to_numpy().astype(np.float64)
    trees: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for lang in sizes:
        own = langs == lang
        if own.any():
            trees[lang] = {k: (grams[own & (length == k)], n[own & (length == k)]) for k in range(1, ORDER + 2)}
    return ContextTrees(trees) if trees else None


_ANY_LETTER = regex.compile(r"\p{L}")


def predict(trees: ContextTrees | None, text: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    data, offsets = column_bytes(text)
    n = len(text)
    lettered = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[data], out=lettered[1:])
    ok = lettered[offsets[1:]] > lettered[offsets[:-1]]
    for i in np.flatnonzero(~ok & (np.diff(offsets) > 0)):
        ok[i] = bool(_ANY_LETTER.search(text[int(i)].as_py()))
    if trees is None:
        return [UNKNOWN] * n, np.zeros(n)
    bits = trees.bits(*normal_grams(data, offsets))
    best = bits.argmin(1)
    score = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
    return [trees.languages[k] if o else UNKNOWN for k, o in zip(best, ok, strict=True)], np.where(ok, score, 0.0)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, with trees learned from ``docs`` itself."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        langs, score = predict(trees.value, part.column(1))
        return pa.RecordBatch.from_arrays(
            [part.column(0).cast(pa.int64()), part.column(2), pa.array(langs, pa.string()), pa.array(score)],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    held = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out")
    return map_slices(docs.select("doc_id", "text", held), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has an identified language."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                langs, _ = predict(trees.value, part.column(part.schema.get_field_index("text")))
                yield part.filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
