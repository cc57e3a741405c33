"""Token savings: facts and summaries over an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.sources.scratch import WrittenTables


def saved(actual: Column, baseline: Column) -> Column:
    """Tokens saved by a call; never negative."""
    return F.greatest(F.lit(0).cast("long"), baseline - actual)


def summary(log: DataFrame, overall: bool = False) -> DataFrame:
    """Calls and token sums by operation; with ``overall``, also a row over all of them (operation ``overall``)."""
    rows = log.withColumn("saved", saved(F.col("actual"), F.col("baseline")))
    grouped = rows.rollup("operation") if overall else rows.groupBy("operation")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total")
    out = grouped.agg(F.count("*").alias("calls"), total("actual"), total("baseline"), total("saved"))
    return out.withColumn("operation", F.coalesce("operation", F.lit("overall"))) if overall else out


def rates(sums: DataFrame) -> DataFrame:
    """Percentage saved (0..100, rounded) and average saved per call (rounded down)."""
    share = F.when(F.col("baseline_total") <= 0, 0).otherwise(F.floor(F.col("saved_total") * 100 / F.col("baseline_total") + 0.5))
    per_call = F.when(F.col("calls") <= 0, 0).otherwise(F.floor(F.col("saved_total") / F.col("calls")))
    percent = F.greatest(F.lit(0), F.least(F.lit(100), share)).cast("long")
    return sums.select("operation", "calls", "saved_total", percent.alias("percent"), per_call.cast("long").alias("per_call"))


def nearest_rank(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, value): each group's value at position ceil(q * n), by counts of distinct values.

    Distinct values are dealt by range and written, so that a group with many is not summed up by one task; each part sums
    its own, after the totals of the parts before it.
    """
    written = WrittenTables(rows.sparkSession, "ranks")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    dealt = written.save(counts.repartitionByRange(n, group, value).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy(group, "part").agg(F.sum("n").alias("own"))
    before = F.sum("own").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(group, "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy(group)).alias("all"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(group, "part").orderBy(value))
    placed = dealt.join(totals, [group, "part"]).withColumn("upto", upto)
    return placed.where(F.col("upto") >= F.ceil(F.col("all") * q)).groupBy(group).agg(F.min(value).alias(value))
