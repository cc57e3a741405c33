"""Keyword, full-text, fuzzy and vector search; rank fusion; overlap suppression and token-budgeted packing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.grams import QuerySets
from siftwell.sources.scratch import WrittenTables

SYMBOL_FUZZY, CONTENT_FUZZY = 0.3, 0.2
RRF_K = 60
BRANCH_LIMIT, MAX_LIMIT = 20, 100


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(T.WORD, query.lower())))


def is_identifier(query: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", query) is not None


def every_word(content: Column, query: str) -> Column:
    """Whether all distinct words of the query are words of the content (never for a query without words)."""
    words = query_words(query)
    if not words:
        return F.lit(False)
    found = F.array_intersect(T.tokens(content), F.array(*[F.lit(w) for w in words]))
    return F.size(found) == len(words)


def word_rank(content: Column, query: str) -> Column:
    """0.8 * h / (h + 5) for the number h of the content's words that the query has; below a contiguous match's 0.85.

    0 unless the content has every word of the query.
    """
    words = query_words(query)
    if not words:
        return F.lit(0.0)
    wanted = F.array(*[F.lit(w) for w in words])
    hits = T.let(T.tokens(content), lambda own: F.filter(own, lambda t: F.array_contains(wanted, t)))
    return T.let(hits, lambda h: F.when(F.size(F.array_distinct(h)) == len(words), F.size(h) * 0.8 / (F.size(h) + 5)).otherwise(0.0))


def measures(query: str, fuzzy: bool = True) -> Column:
    """What one query says of a row (path, symbol, content), as a struct.

    A contiguous match of the symbol or the content outranks every fuzzy one, so the content's trigrams are not looked at then.
    """
    path, symbol, content = F.col("path"), F.col("symbol"), F.col("content")
    in_symbol, in_content = T.contains(symbol, query), T.contains(content, query)
    fields = {
        "in_symbol": in_symbol,
        "in_content": in_content,
        "in_path": T.matches_any(path, [query]) if T.is_glob(query) else T.contains(path, query),
        "rank": word_rank(content, query),
    }
    if fuzzy:
        fields["symbol_similarity"] = T.similarity(symbol, query)
        fields["content_similarity"] = F.when(in_symbol | in_content, 0.0).otherwise(T.similarity(content, query))
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def is_match(m: Column, fuzzy: bool) -> Column:
    plain = m.in_symbol | m.in_content | m.in_path | (m.rank > 0)
    return plain | (m.symbol_similarity > SYMBOL_FUZZY) | (m.content_similarity > CONTENT_FUZZY) if fuzzy else plain


def score(m: Column, fuzzy: bool) -> Column:
    parts = [F.when(m.in_symbol, 1.0).otherwise(0.0), F.when(m.in_content, 0.85).otherwise(0.0), F.when(m.in_path, 0.5).otherwise(0.0), m["rank"]]
    return F.greatest(*parts, *([m.symbol_similarity * 0.9, m.content_similarity * 0.7] if fuzzy else []))


def mode(m: Column, fuzzy: bool) -> Column:
    out = F.when(m.in_symbol, "symbol").when(m.in_content, "exact").when(m["rank"] > 0, "fts")
    if fuzzy:
        out = out.when(m.symbol_similarity > SYMBOL_FUZZY, "symbol").when(m.content_similarity > CONTENT_FUZZY, "fuzzy")
    return out.when(m.in_path, "glob").otherwise("fuzzy" if fuzzy else "fts")


def scored(chunks: DataFrame, query: str, fuzzy: bool = True) -> DataFrame:
    """All matching chunks (path, start_line, end_line, symbol, content, score, mode, symbol_hit); the fuzzy tier is left out of the plan if not wanted.

    The measures of a row are computed once, in a one-element array whose filter keeps the row; a plain filter would be
    pushed below the projection and compute them again.
    """
    kept = F.filter(F.array(measures(query, fuzzy)), lambda m: is_match(m, fuzzy))
    values = F.transform(kept, lambda m: F.struct(F.round(score(m, fuzzy), 6).alias("score"), mode(m, fuzzy).alias("mode"), m.in_symbol.alias("symbol_hit")))
    return chunks.select("path", "start_line", "end_line", "symbol", "content", F.inline(values))


def top_hits(hits: DataFrame, limit: int, query: str = "") -> DataFrame:
    """The best hits, by score; ``rank`` counts from 1. At most MAX_LIMIT rows reach the window.

    For a query that is one identifier, hits of the symbol come before all others.
    """
    limit = max(1, min(limit, MAX_LIMIT))
    first = [F.desc("symbol_hit")] if is_identifier(query) else []
    order = [*first, F.desc("score"), "path", "start_line", "end_line"]
    return hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def scope(rows: DataFrame, subtree: str | None = None, files: list[str] | None = None, focus: DataFrame | None = None) -> DataFrame:
    """Rows whose path lies in a subtree, in a list, or among the focus paths (path); an empty focus keeps nothing."""
    if subtree is not None:
        root = subtree.strip("/")
        return rows.where((F.col("path") == root) | F.col("path").startswith(f"{root}/"))
    if files is not None:
        return rows.where(F.col("path").isin(files))
    if focus is not None:
        return rows.join(focus.select("path").distinct(), "path", "left_semi")
    return rows


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine similarity in double precision; null for a zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    add = lambda acc, x: acc + x
    own = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(own, q, lambda a, b: a * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x * x))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    return 1 - dot / F.nullif(norm * size, F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], limit: int, vector: str = "embedding", tie: tuple[str, ...] = ("path",)) -> DataFrame:
    """The ``limit`` vectors of least cosine distance, exactly, with score max(0, 1 - distance)."""
    d = F.round(cosine_distance(F.col(vector), query), 6)
    near = vectors.withColumn("distance", d).where("distance IS NOT NULL").drop(vector)
    return near.orderBy("distance", *tie).limit(min(limit, MAX_LIMIT)).withColumn("score", F.greatest(F.lit(0.0), F.round(1 - F.col("distance"), 6)))


def fuse(keyword: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (path, start_line, end_line, rank; keyword also mode)."""
    key = ["path", "start_line", "end_line"]
    part = lambda df, source, mode: df.select(*key, (1 / (F.lit(RRF_K) + F.col("rank"))).alias("part"), F.lit(source).alias("source"), mode.alias("mode"))
    both = part(keyword, "keyword", F.col("mode")).unionByName(part(semantic, "semantic", F.lit(None).cast("string")))
    fused = both.groupBy(*key).agg(
        F.round(F.sum("part"), 9).alias("fused"), F.max("mode").alias("mode"), F.bool_or(F.col("source") == "keyword").alias("k"), F.bool_or(F.col("source") == "semantic").alias("s")
    )
    label = F.when(F.col("k") & F.col("s"), "hybrid").when(F.col("s"), "semantic").otherwise(F.col("mode"))
    return fused.select(*key, "fused", label.alias("label")).orderBy(F.desc("fused"), *key).limit(max(1, limit))


def without_overlaps(ranked: DataFrame) -> DataFrame:
    """Ranked hits (rank, path, start_line, end_line; at most MAX_LIMIT) without those that overlap a better kept one."""
    fields = ["rank", "path", "start_line", "end_line"]
    whole = ranked.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))
    kind = "array<struct<rank:bigint,path:string,start_line:bigint,end_line:bigint>>"
    clash = lambda a, b: (a.path == b.path) & (a.end_line >= b.start_line) & (a.start_line <= b.end_line)
    fold = F.aggregate(
        "hits",
        F.array().cast(kind),
        lambda kept, h: F.when(F.exists(kept, lambda k: clash(k, h)), kept).otherwise(F.concat(kept, F.array(h))),
    )
    return whole.select(F.inline(fold))


def chunk_cost(content: Column | None = None) -> Column:
    """Estimated tokens of a chunk with its location line."""
    body = F.col("content") if content is None else content
    return T.token_estimate(F.concat(F.lit("// "), "path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit("\n"), body))


def pack(ranked: DataFrame, budget: int) -> DataFrame:
    """(rank, path, start_line, end_line, tokens, used, trimmed): hits in rank order up to the first that overflows the budget.

    A first hit that overflows alone is cut to the budget and is all that is packed. ``ranked`` has MAX_LIMIT rows at most.
    """
    order = Window.orderBy("rank")
    cost = chunk_cost()
    rows = ranked.withColumn("tokens", cost).withColumn("used", F.sum("tokens").over(order))
    over = F.col("used") > budget
    stopped = F.max(over.cast("int")).over(order) == 1
    cut = chunk_cost(F.substring("content", 1, max(0, budget * T.CHARS_PER_TOKEN - 48)))
    rows = rows.withColumn("trimmed", over & (F.col("rank") == F.min("rank").over(order)))
    kept = rows.withColumn("stopped", stopped).where(~F.col("stopped") | F.col("trimmed"))
    tokens = F.when(F.col("trimmed"), cut).otherwise(F.col("tokens"))
    return kept.select("rank", "path", "start_line", "end_line", tokens.alias("tokens"), F.when(F.col("trimmed"), tokens).otherwise(F.col("used")).alias("used"), "trimmed")


QUERIES = 1024  #: query sets sent to the tasks at once


def fuzzy_join(chunks: DataFrame, queries: DataFrame, threshold: float = CONTENT_FUZZY) -> DataFrame:
    """(query_id, path, start_line, similarity) above the threshold for a table of queries (query_id, query).

    The queries are a stated set, taken in blocks of about ``QUERIES`` (dealt by hash of their id) that are sent to all tasks. There are at
    most 37 * 37 * 37 trigrams, so a block is a table of flags, and the trigrams that a chunk shares with all queries of a block are sums
    of its rows. Nothing is shuffled but the result.
    """
    queries = WrittenTables(queries.sparkSession, "fuzzy").save(queries.select("query_id", "query"))
    n = max(1, -(-queries.count() // QUERIES))
    kinds = dict(chunks.select("path", "start_line").dtypes) | dict(queries.dtypes)
    found = None
    for k in range(n):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).collect()  # about QUERIES rows
        part = _close_to(chunks, [r["query_id"] for r in block], [r["query"] for r in block], threshold, kinds)
        found = part if found is None else found.unionByName(part)
    sim = F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6)
    return found.select("query_id", "path", "start_line", sim.alias("similarity")).where(F.col("similarity") > threshold)


def _close_to(chunks: DataFrame, ids: list, queries: list[str | None], threshold: float, kinds: dict[str, str]) -> DataFrame:
    """(query_id, path, start_line, c, n, m): pairs that reach about the threshold, with common trigrams and both sizes."""
    sent = chunks.sparkSession.sparkContext.broadcast(QuerySets(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = sent.value
        for batch in batches:
            rows = [(k, *x) for k, *x in sets.close(iter(batch.column(2).to_pylist()), threshold)]
            at = np.concatenate([np.full(len(q), k) for k, q, _, _ in rows] or [np.zeros(0, int)])
            of = np.concatenate([q for _, q, _, _ in rows] or [np.zeros(0, int)])
            c = np.concatenate([c for _, _, c, _ in rows] or [np.zeros(0, int)])
            n = np.concatenate([np.full(len(q), n) for _, q, _, n in rows] or [np.zeros(0, int)])
            own = [batch.column(j).take(pa.array(at, pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j in of.tolist()], id_type), *own, pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(sets.size[of], pa.int64())],
                names=["query_id", "path", "start_line", "c", "n", "m"],
            )

    id_type = pa.string() if kinds["query_id"] == "string" else pa.int32() if kinds["query_id"] == "int" else pa.int64()
    schema = f"query_id {kinds['query_id']}, path {kinds['path']}, start_line {kinds['start_line']}, c long, n long, m long"
    return chunks.select("path", "start_line", "content").mapInArrow(run, schema)
