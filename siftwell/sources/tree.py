"""A directory tree as a source: files with hash, language and the reason why one isn't indexed."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.ingest import DEFAULT_IGNORE, MAX_BYTES, binary_reason
from siftwell.operators.scan import scanned
from siftwell.operators.writeback import DuplicateKeys, blocks, duplicate_keys, file_lines
from siftwell.sources.hadoop import Files
from siftwell.sources.scratch import WrittenTables


PATHS = 20_000  #: paths whose contents one reader is asked for


def ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file, without blanks and comments."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, file) of every file below ``root``, by Spark's own listing; no content is read. ``file`` is the full name.

    Spark doesn't list names that begin with a dot or an underscore.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length")
    name = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    inside = F.substring(name, len("/" + base.split(":", 1)[-1].lstrip("/")) + 2, 1 << 20)
    return found.select(inside.alias("path"), F.col("length").alias("size"), F.col("path").alias("file"))


def ignore_files(spark: SparkSession, root: str, depth: int, name: str = ".gitignore") -> DataFrame:
    """(folder, text) of the ignore files below ``root``, looked for by name level by level down to ``depth``."""
    files, base = Files(spark, root), root.rstrip("/")
    top = files.fs.makeQualified(files.path(base)).toString()
    found = [p for d in range(depth + 1) for p in files.matching(f"{base}{'/*' * d}/{name}")]
    rows = [(p.removeprefix(top).strip("/").removesuffix(name).rstrip("/"), files.read(p, MAX_BYTES)) for p in found]
    return spark.createDataFrame(rows, "folder string, text string")


def contents(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, content) of files by name, in readers of ``PATHS`` names; one that can't be read any more has no row."""
    out = spark.createDataFrame([], "file string, content binary")
    for at in range(0, len(files), PATHS):
        reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files[at : at + PATHS]]  # a name is no pattern
        try:
            rows = reader.load(names)
        except AnalysisException:  # some are gone since they were listed
            own = Files(spark, files[at])
            names = [n for n, f in zip(names, files[at : at + PATHS], strict=True) if own.exists(f)]
            rows = reader.load(names) if names else None
        out = out if rows is None else out.unionByName(rows.select(F.col("path").alias("file"), "content"))
    return out


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = MAX_BYTES, allow: list[str] | None = None) -> DataFrame:
    """(path, size, language, content_hash, content, skip_reason) of every file below ``root``, any store Spark can list.

    Paths and sizes come first; the ignore files of all folders, the default rules and ``ignore``, and the size decide; only what is left
    is read. The names of these files are held by the driver, as Spark's own listing does. Content is null for skipped files, whose reasons are
    ignored, too_large, unreadable (gone, or not to be opened) and binary.
    """
    written = WrittenTables(spark, "tree")
    paths = written.save(listed(spark, root))
    deepest = paths.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    rules = ignore_files(spark, root, deepest - 1)
    judged = written.save(scanned(paths, rules, [*DEFAULT_IGNORE, *(ignore or [])], max_bytes, allow))
    wanted = [r["file"] for r in judged.where("skip_reason IS NULL").select("file").toLocalIterator()]
    rows = judged.join(contents(spark, wanted), "file", "left")
    unread = F.col("skip_reason").isNull() & F.col("content").isNull()
    reason = F.coalesce("skip_reason", F.when(unread, "unreadable"), binary_reason(F.col("content")))
    rows = rows.withColumn("skip_reason", reason)
    kept = F.col("skip_reason").isNull()
    return rows.select(
        "path",
        "size",
        F.when(kept, T.language_of(F.col("path"))).alias("language"),
        F.when(kept, F.sha2("content", 256)).alias("content_hash"),
        F.when(kept, F.decode("content", "UTF-8")).alias("content"),
        "skip_reason",
    )


def read_requirements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, content) of requirement files in Markdown; a file that has a key twice is refused, as no write-back of it could be right."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    twice = duplicate_keys(blocks(file_lines(files))).limit(20).collect()
    if twice:
        raise DuplicateKeys(", ".join(f"{r['req_key']} in {r['file']} ({r['times']} times)" for r in twice))
    return files
