"""The codebase guide as one Markdown document, grouped by top-level directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.sources.scratch import WrittenTables
from siftwell.sources.sinks import write_document

#: The document's own sentences.
TITLE = "# Codebase Guide"
DO_NOT_EDIT = "<!-- Generated file: do not edit by hand. -->"
UNDOCUMENTED = "_Undocumented._"
STALE = "_Stale: indexed content hash differs from the captured note hash._"


def top_directory(path: Column) -> Column:
    """The first part of a path, or a dot for a file at the top."""
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(".")


def file_block(path: Column, summary: Column, stale: Column, imports: Column, imported_by: Column) -> Column:
    """A file's part of the guide; every paragraph ends with a blank line."""
    listed = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{label}: "), F.array_join(names, ", ")))
    said = F.when(F.coalesce(summary, F.lit("")) == "", UNDOCUMENTED).otherwise(F.regexp_replace(summary, r"\s+\z", ""))
    parts = [F.concat(F.lit("### "), path), said, F.when(F.coalesce(stale, F.lit(False)), STALE), listed("Imports", imports), listed("Imported by", imported_by)]
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), "\n\n"), F.lit("\n"))


def guide_parts(files: DataFrame) -> DataFrame:
    """(area, path, block): the parts in the order of (area, path); an area's heading has an empty path, and the head of the whole an empty area.

    ``files``: (path, summary, stale, imports, imported_by), the last two sorted arrays of paths.
    """
    area = top_directory(F.col("path"))
    rows = files.select(area.alias("area"), "path", file_block(*[F.col(c) for c in ("path", "summary", "stale", "imports", "imported_by")]).alias("block"))
    heads = rows.select("area").distinct().select("area", F.lit("").alias("path"), F.concat(F.lit("## "), "area", F.lit("\n")).alias("block"))
    written = F.count_if(F.coalesce("summary", F.lit("")) != "")
    cover = F.concat(F.lit("Coverage: documented "), written, F.lit(" / total "), F.count("*"), F.lit(" · stale "), F.count_if(F.coalesce("stale", F.lit(False))))
    top = files.agg(F.concat(F.lit(f"{TITLE}\n\n{DO_NOT_EDIT}\n\n"), cover, F.lit("\n")).alias("block"))
    return top.select(F.lit("").alias("area"), F.lit("").alias("path"), "block").unionByName(heads).unionByName(rows)


def write_guide(files: DataFrame, path: str) -> None:
    """Puts the whole guide in place as one file that ends with one newline."""
    parts = WrittenTables(files.sparkSession, "guide").save(guide_parts(files))
    last = parts.agg(F.max(F.struct("area", "path")).alias("x")).first()["x"]
    end = (F.col("area") == last["area"]) & (F.col("path") == last["path"])
    text = F.when(end, F.regexp_replace("block", r"\n\z", "")).otherwise(F.col("block"))
    write_document(parts.withColumn("block", text), "block", ["area", "path"], path)
