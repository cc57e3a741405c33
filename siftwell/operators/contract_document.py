"""The compact contract document: as many ranked lines as a token budget holds, with a trailer that depends on how many are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T

#: The kinds of lines with their labels, in the order they are printed, and the trailers.
LABELS = {"violation": "Violations", "must": "Must", "must_not": "Must not"}
HEAD = "CONTRACT"
CALL = "call get_requirement_contract / get_requirement_evidence"


def _overflow(omitted: Column) -> Column:
    return F.concat(F.lit("+"), omitted.cast("string"), F.lit(f" more; {CALL}"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _fitted(line: Column, tokens: Column) -> Column:
    """The line, or as much of it as ``tokens`` hold with an ellipsis; empty where they hold nothing."""
    cut = F.concat(F.rtrim(F.substring(line, F.lit(1), (tokens * T.CHARS_PER_TOKEN - 1).cast("int"))), F.lit(T.ELLIPSIS))
    return F.when(T.token_estimate(line) <= tokens, line).otherwise(cut)


def contract_documents(lines: DataFrame, closing: DataFrame, unconfigured: str, budget: int, by: str = "requirement_id") -> DataFrame:
    """(by, document, omitted, truncated) for each row of ``closing`` (by, close).

    ``lines`` (by, place, kind, line) are taken in order of place. The length of every prefix follows from running sums by kind and from
    the trailer for the number left out, so prefixes needn't grow steadily; the first one that doesn't fit ends the document. A
    first line that doesn't fit is cut to what does. Where nothing fits, a fallback says how many there are.
    """
    most = budget * T.CHARS_PER_TOKEN
    order = Window.partitionBy(by).orderBy("place")
    whole = Window.partitionBy(by)
    rows = lines.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(whole)).join(closing, by)
    body = F.lit(len(HEAD))
    for kind, label in LABELS.items():
        own = F.col("kind") == kind
        count, chars = F.sum(own.cast("int")).over(order), F.sum(F.when(own, F.length("line")).otherwise(0)).over(order)
        body = body + F.when(count > 0, len(label) + 1 + chars + 2 * count).otherwise(0)  # a line break, "label: ", and "; " between
    left = F.col("n") - F.col("k")
    trailer = F.when(left > 0, 1 + F.length(_overflow(left))).otherwise(0)
    rows = rows.withColumn("size", body + trailer + 2 + F.length("close"))
    rows = rows.withColumn("stopped", F.max((F.col("size") > most).cast("int")).over(order) == 1)
    # a first line that is too long: the most tokens whose cut still fits
    first = F.col("k") == 1
    room = most - (F.col("size") - F.length("line"))
    tokens = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(budget)), lambda b: F.length(_fitted(F.col("line"), b)) <= room))
    line = F.when(~F.col("stopped"), F.col("line")).when(first & F.col("stopped"), _fitted(F.col("line"), tokens))
    kept = rows.withColumn("line", line).where(F.coalesce("line", F.lit("")) != "")
    clauses = F.sort_array(F.collect_list(F.struct("k", "kind", "line")))
    kept = kept.groupBy(by).agg(clauses.alias("kept"))
    of = lines.groupBy(by).agg(F.count("*").alias("n"))
    out = closing.join(kept, by, "left").join(of, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    omitted = F.col("n") - F.coalesce(F.size("kept"), F.lit(0))
    parts = [F.lit(HEAD)]
    for kind, label in LABELS.items():
        own = F.transform(F.filter("kept", _of_kind(kind)), lambda x: x["line"])
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit(f"{label}: "), F.array_join(own, "; "))))
    parts.append(F.when(omitted > 0, _overflow(omitted)))
    document = F.concat(F.array_join(F.array_compact(F.array(*parts)), "\n"), F.lit("\n\n"), "close")
    bare = lambda close: F.concat(F.lit(f"{HEAD}\n"), _overflow(F.greatest("n", F.lit(1))), F.lit("\n\n"), close)
    fallback = F.when(T.token_estimate(bare(F.col("close"))) <= budget, bare(F.col("close"))).otherwise(bare(F.lit(unconfigured)))
    some = F.col("kept").isNotNull()
    return out.select(
        by, F.when(some, document).otherwise(fallback).alias("document"), F.when(some, omitted).otherwise(F.col("n")).cast("long").alias("omitted"), (~some | (omitted > 0)).alias("truncated")
    )
