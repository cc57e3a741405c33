"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); the root is the component's least node.

    Each step is a grouping with partial minima and a join on the node, written to the shared folder. The minima are written
    before they are joined, so both sides of the join are exchanges of their own and a hub's links can be split over tasks. The
    number of steps grows with the logarithm of the components' size. Nothing is collected but counts.
    """
    edges = scratch.save(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0"
    )
    before, step = _state(edges), 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"min{step}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"large{step}")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"low{step}")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        edges = scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"cc{step}")
        for name in ("cc", "min", "large", "low"):
            scratch.drop(f"{name}{step - 1}")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
