"""Tables written to the shared folder, to cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A folder of this machine takes its place only where the whole session runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siftwell.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("siftwell.scratch.dir", root)
    return root


class WrittenTables:
    """Saves DataFrames as Parquet and reads them back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, name: str) -> DataFrame:
        """Adds rows to a table of that name; all rows so far."""
        path = f"{self.root}/{name}"
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
