"""Sinks: ordered text, whole documents, upserts into Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.sources.hadoop import Files


def write_lines(rows: DataFrame, column: str, order: list[str], path: str) -> None:
    """Text files that hold ``column`` in the given order, read in the order of their names. A range sort, no single task."""
    rows.orderBy(*order).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_document(rows: DataFrame, column: str, order: list[str], path: str) -> None:
    """One text file that holds ``column`` in the given order, put in place in one step.

    Tasks write ranges of it; their bytes are then joined through a buffer, so neither a task nor the driver holds it all.
    """
    files, parts = Files(rows.sparkSession, path), f"{path}.{uuid.uuid4().hex}"
    try:
        write_lines(rows, column, order, parts)
        names = [f"{parts}/{n}" for n in files.names(parts) if n.startswith("part-")]
        files.join(names, f"{parts}/_joined")
        files.replace(f"{parts}/_joined", path)
    finally:
        files.delete(parts)


def append_log(rows: DataFrame, path: str, response: str | None = None) -> None:
    """Appends JSON lines; with ``response``, an estimate of that column's tokens takes its place."""
    if response:
        rows = rows.withColumn("response_tokens", T.token_estimate(F.col(response))).drop(response)
    rows.write.mode("append").json(path)


def upserted(table: DataFrame, changes: DataFrame, key: list[str], deleted: str | None = None) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of equal key; rows marked by ``deleted`` go."""
    kept = table.join(changes.select(*key), key, "left_anti")
    new = changes if deleted is None else changes.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
    return kept.select(*table.columns).unionByName(new.select(*table.columns))


def insert_absent(spark: SparkSession, path: str, rows: DataFrame, key: list[str]) -> int:
    """Appends the rows whose key isn't in the table at ``path`` yet; returns their number, counted while they are written.

    Applied again it finds its own rows and adds none.
    """
    held = spark.read.parquet(path).select(*key)
    seen = Observation()
    new = rows.dropDuplicates(key).join(held, key, "left_anti").observe(seen, F.count(F.lit(1)).alias("n"))
    new.write.mode("append").parquet(path)
    return seen.get["n"]


def write_files(rows: DataFrame, root: str) -> int:
    """Puts each small file (file, content) in place below ``root`` by a rename, one after another; returns how many."""
    files, n = Files(rows.sparkSession, root), 0
    for r in rows.select("file", "content").toLocalIterator():
        target = f"{root.rstrip('/')}/{r['file']}"
        part = f"{target}.{uuid.uuid4().hex}"
        files.write(part, r["content"])
        files.replace(part, target)
        n += 1
    return n
