"""The level-of-detail map: paths rolled up to a tier, weighted edges between tiers, fan-in and fan-out, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.sources.scratch import WrittenTables


def in_scope(path: Column, scope: str) -> Column:
    return F.lit(True) if not scope else (path == scope) | path.startswith(f"{scope}/")


def depth_of(scope: str) -> int:
    return len(scope.split("/")) if scope else 0


def nodes(files: DataFrame, scope: str = "", depth: int = 1) -> DataFrame:
    """(node, is_dir, files, size, loc): files in the scope summed up at ``depth`` segments below it."""
    cutoff = depth_of(scope) + depth
    rows = files.where(in_scope(F.col("path"), scope)).withColumn("node", T.tier(F.col("path"), cutoff))
    return rows.groupBy("node").agg(
        F.bool_or(F.col("path") != F.col("node")).alias("is_dir"), F.count("*").alias("files"), F.sum("size").alias("size"), F.sum("loc").alias("loc")
    )


def node_language(files: DataFrame, depth: int = 1) -> DataFrame:
    """(node, language): the most frequent language; of equal ones that of the least path."""
    rows = files.where("language IS NOT NULL").withColumn("node", T.tier(F.col("path"), depth))
    counts = rows.groupBy("node", "language").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    return counts.groupBy("node").agg(F.min_by("language", F.struct(-F.col("n"), F.col("first"))).alias("language"))


def node_edges(edges: DataFrame, scope: str = "", depth: int = 1, external: bool = False) -> DataFrame:
    """(source, target, kind, weight): edges (src, dst, module, kind) between tier nodes, without self-edges.

    An endpoint outside the scope becomes the scope's sibling; unresolved edges lead to ``ext:module`` if asked for.
    """
    base = depth_of(scope)
    place = lambda p: F.when(in_scope(p, scope), T.tier(p, base + depth)).otherwise(T.tier(p, base + 1))
    src, dst = F.col("src"), F.col("dst")
    resolved = dst != ""
    wanted = (resolved & (in_scope(src, scope) | in_scope(dst, scope)))
    target = F.when(resolved, place(dst))
    if external:
        wanted = wanted | (~resolved & in_scope(src, scope) & (F.col("module") != ""))
        target = target.otherwise(F.concat(F.lit("ext:"), "module"))
    placed = edges.where(wanted).select(place(src).alias("source"), target.alias("target"), "kind")
    return placed.where("source <> target").groupBy("source", "target", "kind").agg(F.count("*").alias("weight"))


def fan(of: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours on either side."""
    pairs = of.select("source", "target").distinct()
    ends = pairs.select(F.inline(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def overlay(node_paths: DataFrame, links: DataFrame) -> DataFrame:
    """(node, section, entries): entries (entry_id, section, path) that touch each node: equal, inside or above it.

    Instead of comparing all paths with all nodes, both sides list their ancestors and are joined on equality.
    """
    above = node_paths.select("node", F.explode(T.ancestors(F.col("node"))).alias("path"))
    touched_from_above = links.join(above, "path").select("node", "section", "entry_id")
    below = links.select("entry_id", "section", F.explode(T.ancestors(F.col("path"))).alias("node"))
    touched_from_below = below.join(node_paths.select("node"), "node").select("node", "section", "entry_id")
    touched = touched_from_above.unionByName(touched_from_below).distinct()
    return touched.groupBy("node", "section").agg(F.count("*").alias("entries"))


CANDIDATES = 1000  #: candidate paths that a scan is asked about at once


def path_overlaps(linked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct (id, candidate) where one path is equal to, a segment suffix of, or inside the other (as text).

    Containment of text can't be an equality join in general, so the candidates are a stated set of paths: about ``CANDIDATES`` of them at a
    time, dealt by hash, are literals that each linked path is tried against.
    """
    names = WrittenTables(candidates.sparkSession, "candidates").save(candidates.select("path").where("path IS NOT NULL").distinct())
    n = max(1, -(-names.count() // CANDIDATES))
    rows = linked.withColumn("clean", F.ltrim(F.lower("path"), F.lit("./")))
    found = None
    for k in range(n):
        block = sorted(r[0] for r in names.where(F.pmod(F.xxhash64("path"), F.lit(n)) == k).collect())
        every = F.array(*[F.lit(p.lower().lstrip("./")) for p in block]) if block else F.array().cast("array<string>")
        hits = rows.select("id", F.explode(F.filter(every, lambda c: F.contains(F.col("clean"), c) | F.contains(c, F.col("clean")))).alias("candidate"))
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()
