"""Which paths of a tree are indexed: nested ignore files decided by joins, before any content is read.

A folder's ignore file speaks of what lies below it. Of all rules that match a path, the last one of the deepest folder decides; whatever
lies below an ignored folder is ignored too, and no deeper rule brings it back. Folders are judged once each, not once for every file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from siftwell.functions.paths import normal_path, path_fault, rule_regex, rules_of

_RULES = ArrayType(StructType([StructField("regex", StringType()), StructField("ignores", BooleanType())]))


def _lines(text: str | None) -> list[tuple[str, bool]]:
    lines = [line.strip() for line in (text or "").splitlines()]
    return [(rule_regex(line.removeprefix("!")), not line.startswith("!")) for line in lines if line and not line.startswith("#")]


def parsed_rules(ignore_files: DataFrame) -> DataFrame:
    """(folder, rules) of ignore files (folder, text); the root's folder is ''. A folder's rules are one ordered list of (regex, ignores)."""
    return ignore_files.select(F.trim("folder", F.lit("/")).alias("folder"), F.udf(lambda text: _lines(text), _RULES)("text").alias("rules"))


def _decided(path: Column, rules: list[tuple[str, bool]]) -> Column:
    return F.coalesce(*[F.when(path.rlike(regex), F.lit(takes)) for regex, takes in reversed(rules)], F.lit(None).cast("boolean"))


def _ancestors(path: Column) -> Column:
    """The folders above a path, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.when(F.size(parts) > 1, 1).otherwise(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _folders(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), _ancestors(path)).otherwise(F.array().cast("array<string>"))


def ignored_targets(targets: DataFrame, rules: DataFrame, root_rules: list[tuple[str, bool]]) -> DataFrame:
    """``targets`` (path, is_folder) that a rule ignores, each judged by itself."""
    shown = F.when(F.col("is_folder"), F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    rows = targets.withColumn("shown", shown).withColumn("base", _decided(F.col("shown"), root_rules) if root_rules else F.lit(None).cast("boolean"))
    above = rows.select("path", "is_folder", "shown", F.explode(F.concat(F.array(F.lit("")), _folders(F.col("path")))).alias("folder"))
    inside = F.substring(F.col("shown"), F.when(F.col("folder") == "", 1).otherwise(F.length("folder") + 2), F.lit(1 << 30))
    found = above.join(rules, "folder").withColumn("inside", inside)
    last = F.try_element_at(F.filter("rules", lambda r: F.regexp_like("inside", r["regex"])), F.lit(-1))["ignores"]
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    found = found.select("path", "is_folder", last.alias("says"), depth.alias("depth")).where(F.col("says").isNotNull())
    nested = found.groupBy("path", "is_folder").agg(F.max_by("says", "depth").alias("says"))
    rows = rows.join(nested, ["path", "is_folder"], "left")
    return rows.where(F.coalesce("says", "base", F.lit(False))).select("path", "is_folder")


def scanned(paths: DataFrame, ignore_files: DataFrame, root_rules: list[str], max_bytes: int, allow: list[str] | None = None) -> DataFrame:
    """``paths`` (path, size, ...) with ``skip_reason``: outside_root, ignored or too_large, else null. Paths come back in their normal form."""
    fault = path_fault(F.col("path"))
    rows = paths.withColumn("fault", fault).withColumn("path", F.coalesce(normal_path(F.col("path")), F.col("path")))
    inside = rows.where(F.col("fault").isNull()).select("path").distinct()
    folders = inside.select(F.explode(_folders(F.col("path"))).alias("path")).distinct()
    targets = inside.withColumn("is_folder", F.lit(False)).unionByName(folders.withColumn("is_folder", F.lit(True)))
    bad = ignored_targets(targets, parsed_rules(ignore_files), rules_of("\n".join(root_rules)))
    below = inside.select("path", F.explode(_folders(F.col("path"))).alias("folder")).join(bad.where("is_folder").select(F.col("path").alias("folder")), "folder").select("path")
    ignored = below.unionByName(bad.where("NOT is_folder").select("path")).distinct().withColumn("bad", F.lit(True))
    rows = rows.join(ignored, "path", "left")
    out = F.col("bad").isNotNull()
    if allow:
        out = out | ~F.coalesce(_decided(F.col("path"), rules_of("\n".join(allow))), F.lit(False))
    reason = F.when(F.col("fault").isNotNull(), "outside_root").when(out, "ignored").when(F.col("size") > max_bytes, "too_large")
    return rows.withColumn("skip_reason", reason).drop("fault", "bad")
