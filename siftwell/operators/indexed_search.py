"""Keyword search on postings: the same hits and scores as a scan of all chunks, without reading their texts.

Trigram counts give the similarities exactly (common trigrams, and the sizes kept with the chunks). A fuzzy hit must have more than the
threshold's share of the query's trigrams, so counts below that are dropped before the chunks are named. A query of word
characters only is a substring of a content exactly if it is one of some word of it, which the word postings tell; any other query
is looked up by the trigrams that its pieces must have, and verified in the texts of these candidates alone, bucket by bucket.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import search as K
from siftwell.operators.reindex import SHIFT
from siftwell.sources.scratch import WrittenTables
from siftwell.sources.snapshot import SnapshotStore


def necessary_grams(query: str) -> list[str]:
    """Trigrams that every text with ``query`` as a substring has: those inside its runs of letters and digits, and at their ends within the query."""
    text, out = query.lower(), {}
    for m in re.finditer("[a-z0-9]+", text):
        padded = ("  " if m.start() > 0 else "") + m[0] + (" " if m.end() < len(text) else "")
        out |= dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2))
    return list(out)


def _is_word(query: str) -> bool:
    """Whether all its characters are those of words."""
    return re.fullmatch("[a-z0-9_]+", query.lower()) is not None


def candidates(store: SnapshotStore, query: str, fuzzy: bool = True) -> DataFrame:
    """(cid, words, hits, common, common_symbol, maybe_content, maybe_symbol, maybe_path) of the chunks that postings can't rule out.

    ``maybe_content`` is certain for a query of word characters.
    """
    rows = store.read("postings")
    grams, needed, words = T.literal_trigrams(query), necessary_grams(query), K.query_words(query)
    one_word = _is_word(query)
    field, gram = F.col("field"), F.col("gram")
    asked = F.lit(False)
    if needed or (fuzzy and grams):
        asked = asked | (field.isin("c", "s", "p") & gram.isin(sorted({*needed, *(grams if fuzzy else ())})))
    if words:
        asked = asked | ((field == "w") & gram.isin(words))
    if one_word:
        asked = asked | ((field == "w") & gram.contains(query.lower()))
    found = rows.where(asked).select("field", "gram", F.inline("chunks"))
    times = lambda c, x=1: F.sum(F.when(c, x).otherwise(0))
    all_of = lambda f: (times((field == f) & gram.isin(needed)) == len(needed)) if needed else F.lit(True)
    of_query = gram.isin(grams) if grams else F.lit(False)
    of_words = (field == "w") & gram.isin(words) if words else F.lit(False)
    content = (times((field == "w") & gram.contains(query.lower())) > 0) if one_word else all_of("c")
    counted = found.groupBy("cid").agg(
        times(of_words).alias("words"), times(of_words, F.col("times")).alias("hits"), times((field == "c") & of_query).alias("common"),
        times((field == "s") & of_query).alias("common_symbol"), content.alias("maybe_content"), all_of("s").alias("maybe_symbol"), all_of("p").alias("maybe_path"),
    )
    close = (F.col("common") > K.CONTENT_FUZZY * len(grams)) | (F.col("common_symbol") > K.SYMBOL_FUZZY * len(grams)) if fuzzy else F.lit(False)
    return counted.where(F.col("maybe_content") | F.col("maybe_symbol") | F.col("maybe_path") | close | ((F.col("words") == len(words)) & F.lit(bool(words))))


def scored(store: SnapshotStore, query: str, fuzzy: bool = True) -> DataFrame:
    """All matching chunks (path, start_line, end_line, symbol, score, mode, symbol_hit), as ``search.scored`` finds them in the chunks themselves."""
    manifest = store.manifest()
    grams, words = T.literal_trigrams(query), K.query_words(query)
    named = store.read("chunks", manifest=manifest).select("cid", "path", "start_line", "end_line", "symbol", "n_content", "n_symbol")
    rows = candidates(store, query, fuzzy)
    if len(necessary_grams(query)) == 0 or T.is_glob(query):
        # nothing to look up for a short query, or a path pattern: all chunks' names are tried, not their texts
        none = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("words", "hits", "common", "common_symbol")}
        maybe = {c: F.coalesce(F.col(c), F.lit(c != "maybe_content" or not _is_word(query))) for c in ("maybe_content", "maybe_symbol", "maybe_path")}
        rows = named.join(rows, "cid", "left").withColumns(none | maybe)
    else:
        rows = rows.join(named, "cid")
    in_symbol = F.col("maybe_symbol") & T.contains(F.col("symbol"), query)
    in_path = T.matches_any(F.col("path"), [query]) if T.is_glob(query) else F.col("maybe_path") & T.contains(F.col("path"), query)
    rank = F.when(F.col("words") == len(words), F.col("hits") * 0.8 / (F.col("hits") + 5)).otherwise(0.0) if words else F.lit(0.0)
    similar = lambda common, n: F.col(common) / F.nullif(F.col(n) + len(grams) - F.col(common), F.lit(0)) if grams else F.lit(0.0)
    rows = rows.withColumns({"in_symbol": in_symbol, "in_path": in_path, "rank": rank, "in_content": F.col("maybe_content")})
    if not _is_word(query):
        rows = _verified(store, manifest, rows, query)
    measures = {c: F.col(c) for c in ("in_symbol", "in_content", "in_path", "rank")}
    if fuzzy:
        measures["symbol_similarity"] = F.coalesce(similar("common_symbol", "n_symbol"), F.lit(0.0))
        measures["content_similarity"] = F.when(F.col("in_symbol") | F.col("in_content"), 0.0).otherwise(F.coalesce(similar("common", "n_content"), F.lit(0.0)))
    m = _Fields(measures)
    values = {"score": F.round(K.score(m, fuzzy), 6), "mode": K.mode(m, fuzzy), "symbol_hit": F.col("in_symbol")}
    return rows.where(K.is_match(m, fuzzy)).select("path", "start_line", "end_line", "symbol", *[c.alias(n) for n, c in values.items()])


def similarities(store: SnapshotStore, query: str) -> DataFrame:
    """(path, start_line, content_sim, symbol_sim) of the chunks whose content or symbol is similar enough to ``query``."""
    m = len(T.literal_trigrams(query))
    named = store.read("chunks").select("cid", "path", "start_line", "n_content", "n_symbol")
    rows = candidates(store, query).join(named, "cid")
    sim = lambda common, n, name: F.round(F.coalesce(F.col(common) / F.nullif(F.col(n) + m - F.col(common), F.lit(0)), F.lit(0.0)), 6).alias(name)
    rows = rows.select("path", "start_line", sim("common", "n_content", "content_sim"), sim("common_symbol", "n_symbol", "symbol_sim"))
    return rows.where((F.col("content_sim") > K.CONTENT_FUZZY) | (F.col("symbol_sim") > K.SYMBOL_FUZZY))


class _Fields(dict):
    """Columns by name, as fields of a struct are reached."""

    def __getattr__(self, name: str) -> Column:
        return self[name]


def _verified(store: SnapshotStore, manifest: dict, rows: DataFrame, query: str) -> DataFrame:
    """``rows`` whose ``in_content`` is looked up in the text where postings allow it; only buckets with such rows are read."""
    rows = WrittenTables(store.spark, "candidates").save(rows)
    open_ = rows.where("in_content").select("cid")
    buckets = [r["b"] for r in open_.select(F.shiftright("cid", SHIFT).alias("b")).distinct().collect()]  # one for each bucket at most
    texts = store.read("chunks", buckets, manifest).select("cid", "content")
    sure = texts.where(T.contains(F.col("content"), query)).select("cid", F.lit(True).alias("sure"))
    return rows.join(sure, "cid", "left").withColumn("in_content", F.col("in_content") & F.coalesce("sure", F.lit(False))).drop("sure")
