"""Shared plumbing of the training-data operators: table access, shared scratch tables, slice maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.textcodes import slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the input tables by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, modulus: int):
    """crc32 of the id's text, modulo ``modulus``: the hold-out rule. A null id is in no fold (null)."""
    return F.crc32(F.col(col).cast("string")) % modulus


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares. A folder of this machine takes its place only where the whole session runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siftwell.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("siftwell.scratch.dir", root)
    return root


class Scratch:
    """Tables written to the shared folder to cut lineage. ``drop`` removes those no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_slices(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text"
) -> DataFrame:
    """Applies ``fn`` to slices of bounded text size of the Arrow batches of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield fn(part)

    return df.mapInArrow(run, schema)


def worker_file(path: str) -> str:
    """A vocabulary file must be readable on every worker; say so plainly when it is not."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} must exist on the driver and on every worker")
    return path
