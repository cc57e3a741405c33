"""Incremental indexing as a stream: each micro-batch of new file versions is chunked and replaces the old ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.ingest import line_windows
from siftwell.operators.reindex import full_index, incremental_index
from siftwell.sources.snapshot import SnapshotStore

VERSIONS = "path string, content string, version long"
DEBOUNCE = "800 milliseconds"


def versions(spark: SparkSession, inbox: str, max_files: int = 1000) -> DataFrame:
    """File versions dropped as JSON lines into ``inbox``."""
    return spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", max_files).json(inbox)


def index_batch(out: str, window: int) -> Callable[[DataFrame, int], None]:
    """Writes the newest version of each path in the batch, and its chunks, to folders of the batch's own.

    A version without content says that the file is gone: it has no chunks. A batch that runs again overwrites what it
    wrote, so each is applied once however often it is tried.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("content", "version"), "version").alias("x")).select("path", "x.*")
        newest.select("path", "version").write.mode("overwrite").parquet(f"{out}/versions/batch={number}")
        cut = line_windows(newest.where("content IS NOT NULL"), window).withColumn("chunk_hash", F.sha2("content", 256))
        cut.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    return write


def watch(spark: SparkSession, inbox: str, out: str, checkpoint: str, window: int = 80, once: bool = False) -> StreamingQuery:
    """Starts the stream; with ``once`` it stops when the inbox is read."""
    writer = versions(spark, inbox).writeStream.foreachBatch(index_batch(out, window)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def snapshot_batch(store: SnapshotStore, window: int) -> Callable[[DataFrame, int], None]:
    """Brings the snapshot index in line with a batch of file versions: one commit for chunks, symbols, imports, postings and versions.

    Of each path the newest version counts, and none older than the one the index holds, so late versions change nothing. A batch
    that runs again, after its commit too, leaves the same state.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not store.manifest()["version"]:
            full_index(store, batch.select("path", "content").limit(0), window)
        newest = batch.groupBy("path").agg(F.max_by(F.struct("content", "version"), "version").alias("x")).select("path", "x.*")
        if "versions" in store.manifest()["tables"]:
            held = store.read("versions").select("path", F.col("version").alias("held"))
            newest = newest.join(held, "path", "left").where("held IS NULL OR version >= held").drop("held")
        newest = newest.persist()
        try:
            gone = newest.where("content IS NULL").select("path")
            incremental_index(store, newest.where("content IS NOT NULL").select("path", "content"), gone, window, newest.select("path", "version"))
        finally:
            newest.unpersist()

    return write


def watch_index(spark: SparkSession, inbox: str, store: SnapshotStore, checkpoint: str, window: int = 80, once: bool = False) -> StreamingQuery:
    """Starts a stream that keeps a snapshot index in line with an inbox of file versions, one micro-batch each ``DEBOUNCE``."""
    writer = versions(spark, inbox).writeStream.foreachBatch(snapshot_batch(store, window)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def newest_versions(spark: SparkSession, out: str) -> DataFrame:
    """(path, version, batch) of each path's newest version; of equal versions the one that came last."""
    rows = spark.read.parquet(f"{out}/versions").groupBy("path").agg(F.max(F.struct("version", "batch")).alias("x"))
    return rows.select("path", "x.*")


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each path's newest version over all batches; none for a path whose newest version says it is gone."""
    return spark.read.parquet(f"{out}/chunks").join(newest_versions(spark, out), ["path", "version", "batch"])


def compact(spark: SparkSession, out: str, to: str) -> None:
    """Writes the present state as the one batch of a new folder, to be read and watched on in place of ``out``.

    Paths that are gone keep their version, so that an older one that comes late doesn't bring them back.
    """
    current_chunks(spark, out).drop("batch").write.mode("overwrite").parquet(f"{to}/chunks/batch=-1")
    newest_versions(spark, out).drop("batch").write.mode("overwrite").parquet(f"{to}/versions/batch=-1")
