"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Words are lower-cased (A-Z) runs of non-blank bytes, with one end token per text. The ``VOCABULARY`` most
frequent training words are dealt into classes of ``WIDTH`` by rank; every other word belongs to one of
``FORMS`` form classes, by a hash of its last three bytes, and there to one of ``WIDTH`` buckets, by a hash of the whole
word. With h the words before,

    P(w | h) = P(class | h) * P(w | class, h)                          for a vocabulary word
    P(w | h) = P(class | h) * P(bucket | class, h) * (c + 1) / M       for any other word with training count c

where M sums c + 1 over the bucket's training words, plus one for words never seen. Both softmaxes have
weights hashed from n-gram and skip features of h: the last word, the last two, the second and the third last.

Counts cover every training text and are summed by Spark. The number of hashed weight rows follows the number of training
tokens, within ``LEAST_ROWS`` and ``MOST_ROWS``. Training makes one pass over every training text in ``ROUNDS`` rounds.
A round deals its texts by hash into groups of ``GROUP`` tokens a weight row; each group runs gradient steps from the
current weights on its texts in the order of their hashes, and Spark averages the changes row by row, weighted by how often a
group used the row. Groups follow the data alone, so neither the cluster's settings nor the layout of the table changes the
result. Counts of rare words are joined, never collected: tasks get only the ``FREQUENT`` most frequent words.

Words are told apart by 64-bit hashes. Defined results for odd input: a null or empty text is one end token; a null id is not
learned from nor held out; repeated rows count and are scored each; without training rows every count is
0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, fold, map_slices
from siftwell.llm.textcodes import Words, column_bytes, mix64, slices

FOLDS, HELD = 7, 2
WIDTH = 64  #: words or buckets of a class, and classes
FORMS = 32
VOCABULARY = WIDTH * (WIDTH - FORMS)
FREQUENT = 300_000
STEPS = 100_000  #: counts up to which each is a step of its own
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 16  #: hashed weight rows of each softmax
TOKENS_PER_ROW = 1024
ROUNDS = 2
GROUP = 64
MOST_GROUPS = 1 << 15
STEP = 0.08
BATCH = 8192
MAX_SCORE = np.float32(80)  #: keeps exp() of a score finite in single precision
FEW = 12
FLUSH = 500_000  #: distinct words a task holds before it passes its counts on

START = VOCABULARY + FORMS * WIDTH  #: the code of what stands before a text
_END = np.int64(-0x61C8864680B583EB)  #: stands for the end token among word hashes
_BIASES = 1 + WIDTH  #: row 0: class biases; then the biases inside each class
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (int64) and form classes of all tokens of a slice, ends included, and the texts' bounds in them."""
    words = Words(*column_bytes(text))
    n = np.diff(words.bounds)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    ends = bounds[1:] - 1
    at = np.arange(len(words.starts)) + np.repeat(np.arange(len(n)), n)
    h = np.full(bounds[-1], _END, np.int64)
    h[at] = words.hashes(lower=True).view(np.int64)
    form = np.zeros(bounds[-1], np.int64)
    tail = np.zeros(len(words.starts), np.uint64)
    for k in (3, 2, 1):
        p = words.ends - k
        tail = tail * _U(257) + np.where(p >= words.starts, _LOWER[words.data[np.maximum(p, 0)]] + _U(1), _U(0))
    form[at] = (mix64(tail) % _U(FORMS)).astype(np.int64)
    form[ends] = 0
    return h, form, bounds


def bucket_of(h: np.ndarray) -> np.ndarray:
    """The bucket of each word in its form class."""
    return (mix64(h.view(np.uint64) ^ _U(0x2545F4914F6CDD1D)) % _U(WIDTH)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, form, c): training counts of every distinct token of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, form, c = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return keys, form[first], np.bincount(inverse, weights=c, minlength=len(keys)).astype(np.int64)

        def rows(x):
            return pa.RecordBatch.from_arrays([pa.array(a) for a in x], names=["h", "form", "c"])

        for batch in batches:
            for part in slices(batch):
                h, form, _ = tokens(part.column(0))
                keys, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((keys, form[first], c))
                if sum(len(x[0]) for x in held) > FLUSH:
                    held = [merged()]
                    if len(held[0][0]) > FLUSH // 2:
                        yield rows(held.pop())
        if held:
            yield rows(merged())

    return docs.select("text").mapInArrow(run, "h long, form long, c long").groupBy("h").agg(F.min("form").alias("form"), F.sum("c").alias("c"))


def bucket_sums(counts: DataFrame) -> DataFrame:
    """(form, bucket, m): sums of c + 1 over the words of ``counts`` (h, form, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FORMS * WIDTH, np.int64)
        for b in batches:
            at = b.column(1).to_numpy() * WIDTH + bucket_of(b.column(0).to_numpy())
            np.add.at(total, at, b.column(2).to_numpy() + 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full // WIDTH), pa.array(full % WIDTH), pa.array(total[full])], names=["form", "bucket", "m"])

    parts = counts.select("h", "form", "c").mapInArrow(run, "form long, bucket long, m long")
    return parts.groupBy("form", "bucket").agg(F.sum("m").alias("m"))


class Frequent:
    """Counts of the most frequent words by hash, and the codes of those in the vocabulary."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.lexsort((h, -c))
        h, c = h[order], c[order]
        end = np.flatnonzero(h == _END)
        h, c = np.concatenate([[_END], np.delete(h, end)]), np.concatenate([c[end] if len(end) else [0], np.delete(c, end)])
        code = np.full(len(h), -1)
        code[:VOCABULARY] = np.arange(min(VOCABULARY, len(h)))
        self.vocabulary_counts = c[:VOCABULARY].astype(np.float64)
        order = np.argsort(h)
        self.h, self.c, self.code = h[order], c[order].astype(np.int64), code[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count (-1 where the word isn't held) and the vocabulary code (-1 where it has none) of each word."""
        keys, inverse = np.unique(h, return_inverse=True)
        row = np.minimum(np.searchsorted(self.h, keys), len(self.h) - 1)
        known = self.h[row] == keys
        return np.where(known, self.c[row], -1)[inverse], np.where(known, self.code[row], -1)[inverse]


def rows_for(n_train: int) -> int:
    """Hashed weight rows for so many training tokens: a power of two."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, int(n_train / TOKENS_PER_ROW).bit_length() - 1)))


class Places:
    """Class and place in it of each token, and the weight rows of its context in both softmaxes."""

    def __init__(self, h: np.ndarray, form: np.ndarray, code: np.ndarray, bounds: np.ndarray, n_rows: int):
        self.n_rows = n_rows
        known = code >= 0
        bucket = bucket_of(h)
        self.classes = np.where(known, code // WIDTH, WIDTH - FORMS + form)
        self.place = np.where(known, code % WIDTH, bucket)
        own = np.where(known, code, VOCABULARY + form * WIDTH + bucket)
        before = np.full((3, len(own)), START)
        nth = np.arange(len(own)) - np.repeat(bounds[:-1], np.diff(bounds))
        for k in (1, 2, 3):
            before[k - 1, k:] = own[:-k]
            before[k - 1][nth < k] = START
        one, two, three = before.astype(np.uint64)
        kinds = (one, (one << _U(16)) | two | _U(1 << 40), two | _U(2 << 40), three | _U(3 << 40))
        self.context = np.stack([self._hashed(k) for k in kinds], axis=1)

    def _hashed(self, x: np.ndarray) -> np.ndarray:
        return (mix64(x) & _U(self.n_rows - 1)).astype(np.int64)

    def class_rows(self, s: slice) -> np.ndarray:
        """The class biases and the rows of the context."""
        own = self.context[s]
        return np.concatenate([np.zeros((len(own), 1), np.int64), own + _BIASES], axis=1)

    def word_rows(self, s: slice) -> np.ndarray:
        """The biases inside the class, and the rows of the last and the second last word with the class."""
        classes = self.classes[s][:, None]
        with_class = self._hashed(((self.context[s][:, [0, 2]] << 8) | classes).astype(np.uint64))
        return np.concatenate([1 + classes, with_class + _BIASES + self.n_rows], axis=1)


def _exponentials(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        x += weights.take(rows[:, k], axis=0)
    np.minimum(x, MAX_SCORE, out=x)
    return np.exp(x, out=x)


def _softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = _exponentials(weights, rows)
    x /= x.sum(1, keepdims=True)
    return x


def _log_softmax_at(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 of one probability for each row of features."""
    x = _exponentials(weights, rows)
    return np.log10(np.maximum(x[np.arange(len(x)), target] / x.sum(1), 1e-30))


def initial_weights(vocabulary: np.ndarray, buckets: np.ndarray, n_rows: int) -> np.ndarray:
    """Biases from the counts; all else 0. Places of a class without a word are never predicted."""
    w = np.zeros((_BIASES + 2 * n_rows, WIDTH), np.float32)
    padded = np.full(VOCABULARY, -1.0)
    padded[: len(vocabulary)] = vocabulary
    table = padded.reshape(-1, WIDTH)
    w[0, : WIDTH - FORMS] = np.log(np.where(table >= 0, table + 1, 0).sum(1) + 1e-9)
    w[0, WIDTH - FORMS :] = np.log(buckets.sum(1))
    w[1 : 1 + WIDTH - FORMS] = np.where(table >= 0, np.log(np.maximum(table, 0) + 1), -30.0)
    w[1 + WIDTH - FORMS : _BIASES] = np.log(buckets)
    return w


def log_probabilities(w: np.ndarray, at: Places) -> np.ndarray:
    """log10 of P(class | h) * P(place | class, h) of each token, in batches."""
    p = np.empty(len(at.classes))
    for a in range(0, len(p), BATCH):
        s = slice(a, a + BATCH)
        p[s] = _log_softmax_at(w, at.class_rows(s), at.classes[s])
        p[s] += _log_softmax_at(w, at.word_rows(s), at.place[s])
    return p


def _run_sums(g: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of the rows ``order`` of ``g``; a run begins at ``first`` and is ``n`` long: up to FEW rows for all runs at once, the rest run by run."""
    out = g.take(order[first], axis=0)
    for k in range(1, FEW):
        longer = np.flatnonzero(n > k)
        if not len(longer):
            return out
        out[longer] += g.take(order[first[longer] + k], axis=0)
    for r in np.flatnonzero(n > FEW).tolist():
        a, b = first[r] + FEW, first[r] + n[r]
        out[r] += np.ones(b - a, np.float32) @ (g[a:b] if n[r] == len(g) else g.take(order[a:b], axis=0))
    return out


def _grouped(rows: np.ndarray) -> np.ndarray:
    """A stable order by row; rows of one feature lie close enough together to be sorted as 16-bit numbers."""
    low = rows.min()
    near = rows.max() - low < 1 << 16
    return np.argsort((rows - low).astype(np.uint16 if near else np.int32), kind="stable")


def _descend(w: np.ndarray, used: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One gradient step on a batch, feature by feature; a row's step shrinks with the root of its uses."""
    if not len(rows):
        return
    g = _softmax(w, rows)
    g[np.arange(len(g)), target] -= 1
    for k in range(rows.shape[1]):
        order = _grouped(rows[:, k])
        own = rows[order, k]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n = np.diff(np.append(first, len(own)))
        keys = own[first]
        used[keys] += n
        total = _run_sums(g, order, first, n)
        total *= (STEP / np.sqrt(used[keys])).astype(np.float32)[:, None]
        w[keys] -= total


def _packed(v: np.ndarray) -> pa.Array:
    """Rows of WIDTH numbers as binary half-precision values."""
    size = 2 * WIDTH
    raw = np.clip(v, -60000, 60000).astype("<f2").tobytes()
    ends = np.arange(0, size * len(v) + 1, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])


def _unpacked(col: pa.Array) -> np.ndarray:
    col = col.cast(pa.binary())
    if not len(col):
        return np.zeros((0, WIDTH))
    _, ends, raw = col.buffers()
    at = np.frombuffer(ends, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view("<f2").reshape(-1, WIDTH).astype(np.float64)


def _row_batches(row: np.ndarray, n: np.ndarray, v: np.ndarray, **more: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(row), 4096):
        s = slice(a, a + 4096)
        own = [pa.array(row[s]), pa.array(n[s]), _packed(v[s])]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.full(len(row[s]), x)) for x in more.values())], names=["row", "n", "v", *more])


def train_round(docs: DataFrame, groups: int, n_rows: int, frequent, weights) -> DataFrame:
    """(row, n, v): uses and mean change of each weight row, over the groups of ``docs`` (doc_id, text). Changes travel in half precision."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = weights.value
        w, used, group = start.copy(), np.zeros(len(start)), None
        for batch in batches:
            for part in slices(batch):
                # a partition is one group, unless groups were dealt otherwise
                own = part.column(1).to_numpy()
                ends = [*(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    if own[a] != group:
                        if group is not None:
                            yield from changes(start, w, used, group)
                            w, used = start.copy(), np.zeros(len(start))
                        group = int(own[a])
                        used[:_BIASES] = 10_000
                    h, form, bounds = tokens(part.column(0).slice(a, b - a))
                    at = Places(h, form, frequent.value.find(h)[1], bounds, n_rows)
                    for k in range(0, len(h), BATCH):
                        s = slice(k, k + BATCH)
                        _descend(w, used, at.class_rows(s), at.classes[s])
                        _descend(w, used, at.word_rows(s), at.place[s])
        if group is not None:
            yield from changes(start, w, used, group)

    def changes(start: np.ndarray, w: np.ndarray, used: np.ndarray, group: int) -> Iterator[pa.RecordBatch]:
        used[:_BIASES] -= 10_000
        row = np.flatnonzero(used > 0)
        yield from _row_batches(row, used[row], w[row] - start[row], g=group)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted: the last row of a batch may go on in the next
        row, n, v = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, WIDTH))
        for batch in batches:
            uses = batch.column(1).to_numpy()
            row = np.concatenate([row, batch.column(0).to_numpy()])
            n, v = np.concatenate([n, uses]), np.concatenate([v, _unpacked(batch.column(2)) * uses[:, None]])
            if not len(row):
                continue
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            row, n, v = row[first], np.add.reduceat(n, first), np.add.reduceat(v, first)
            yield from _row_batches(row[:-1], n[:-1], v[:-1] / n[:-1, None])
            row, n, v = row[-1:], n[-1:], v[-1:]
        yield from _row_batches(row, n, v / n[:, None])

    mark = F.xxhash64("doc_id", "text", F.lit("group"))
    dealt = docs.select("text", F.pmod(mark, F.lit(groups)).cast("int").alias("g"), mark.alias("k"))
    dealt = dealt.repartitionById(groups, "g").sortWithinPartitions("g", "k").select("text", "g")
    parts = dealt.mapInArrow(descend, "row long, n double, v binary, g long")
    return parts.repartition("row").sortWithinPartitions("row", "g").select("row", "n", "v").mapInArrow(add, "row long, n double, v binary")


def _moved(weights: np.ndarray, changes: DataFrame) -> np.ndarray:
    found = changes.select("row", "v").toArrow()  # at most one row for each of the bounded number of weight rows
    out = weights.copy()
    if found.num_rows:
        found = found.combine_chunks()
        out[found.column("row").to_numpy()] += np.concatenate([_unpacked(c) for c in found.column("v").chunks]).astype(np.float32)
    return out


def frequent_words(counts: DataFrame) -> DataFrame:
    """(h, c) of the most frequent words, ``FREQUENT`` at most, and of the end.

    Words are taken by whole steps of their count, from the top, as long as all taken fit the bound: a step is one count up to
    ``STEPS``, and beyond it a 4096th of a doubling, so the table of steps is bounded too.
    """
    step = F.when(F.col("c") <= STEPS, F.col("c")).otherwise(STEPS + 1 + F.floor(F.log2(F.col("c") / STEPS) * 4096)).cast("long")
    rows = counts.select("h", "c", step.alias("step"))
    least, left = (1 << 62), 0
    for r in sorted(rows.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        if (left := left + r["words"]) > FREQUENT:
            break
        least = r["step"]
    return rows.where((F.col("step") >= least) | (F.col("h") == int(_END))).select("h", "c")


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "maxent")
    context = spark.sparkContext
    training = docs.where(fold("doc_id", FOLDS) != HELD)
    counts = scratch.save(count_words(training), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_distinct = total["n"], total["v"]

    top = frequent_words(counts).toArrow()  # FREQUENT words at most, and the end
    frequent_ = Frequent(top.column("h").to_numpy(), top.column("c").to_numpy())
    frequent = context.broadcast(frequent_)
    inside = np.sort(frequent_.h[frequent_.code >= 0])
    vocabulary = spark.createDataFrame([(int(x),) for x in inside], "h long")
    outside = counts.join(F.broadcast(vocabulary), "h", "left_anti")
    buckets = np.ones((FORMS, WIDTH))
    for r in bucket_sums(outside).collect():  # FORMS * WIDTH rows at most
        buckets[r["form"], r["bucket"]] += r["m"]

    n_rows = rows_for(n_train)
    groups = min(MOST_GROUPS, max(1, -(-n_train // (ROUNDS * GROUP * n_rows))))
    weights = initial_weights(frequent_.vocabulary_counts, buckets, n_rows)
    for k in range(ROUNDS):
        part = training.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == k)
        weights = _moved(weights, train_round(part, groups, n_rows, frequent, context.broadcast(weights)))
    model = context.broadcast((weights, np.log10(buckets)))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        h, form, bounds = tokens(part.column(1))
        c, code = frequent.value.find(h)
        w, log_buckets = model.value
        place = Places(h, form, code, bounds, n_rows)
        p = log_probabilities(w, place)
        out = code < 0
        held = c >= 0
        base = np.where(held, np.log10(np.maximum(c, 0) + 1.0), 0.0)
        p += np.where(out, base - log_buckets[form, place.place], 0.0)
        at = bounds[:-1]
        doc = np.repeat(np.arange(len(at)), np.diff(bounds))
        # what the frequent words don't tell is looked up later: distinct rare words of each text, with their times
        rare = np.flatnonzero(~held)
        order = rare[np.lexsort((h[rare], doc[rare]))]
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))
        offsets = pa.array(np.searchsorted(doc[order[first]], np.arange(len(at) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[order[first]], times)]
        return pa.RecordBatch.from_arrays(
            [part.column(0).cast(pa.int64()), part.column(2)]
            + [pa.array(x) for x in (np.diff(bounds), np.add.reduceat((held & (c > 0)).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(p, at))]
            + lists,
            names=["doc_id", "held_out", "n_tokens", "known", "base", "p", "rare", "times"],
        )

    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, p double, rare array<long>, times array<long>"
    scored = map_slices(docs.select("doc_id", "text", held_out), run, schema)
    scored = scratch.save(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    looked = (
        rare.join(counts.select("h", "c"), "h")
        .groupBy("rid")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("extra"))
    )
    none = float(np.log10(n_train + n_distinct + 1.0))
    extra = F.coalesce("extra", F.lit(0.0))
    return scored.drop("rare", "times").join(looked, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(none)).alias("base_score"),
        (F.col("p") + extra).alias("score"),
    )
