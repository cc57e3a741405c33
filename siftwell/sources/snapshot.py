"""Tables that change together: a manifest of bucket versions behind one atomic pointer.

A store has a folder for each commit, with its tables in bucket partitions (``bucket=k``), a manifest for each commit that names for
every table and bucket the folder that holds it, and the file ``CURRENT`` with the name of the manifest in force. A commit writes only
the buckets it changes; all others stay where they are, unread. The pointer is replaced by a rename, after everything else is
written, so a reader sees all of a commit or nothing of it, and a writer that dies leaves the old state in force. A commit
that was prepared on a state which is no longer in force is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siftwell.sources.hadoop import Files


class Conflict(RuntimeError):
    """Another commit came first."""


def bucket_of(path, buckets: int):
    """The bucket of a path column."""
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` dealt by ``bucket``; to more partitions than the session's where these would get several of the buckets each."""
    wide = 4 * buckets > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(4 * buckets, "bucket") if wide else rows.repartition("bucket")


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.files = Files(spark, self.root)

    def manifest(self) -> dict:
        """{version, tables: {name: {schema, buckets: {bucket: folder}}}} of the state in force."""
        if not self.files.exists(f"{self.root}/CURRENT"):
            return {"version": "", "tables": {}}
        return json.loads(self.files.read(f"{self.root}/manifests/{self.files.read(f'{self.root}/CURRENT')}.json"))

    def read(self, table: str, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table with its ``bucket``, of all buckets or of some; only those are listed and read."""
        held = (manifest or self.manifest())["tables"][table]
        schema = StructType.fromJson(held["schema"])
        wanted = held["buckets"] if buckets is None else {str(b): held["buckets"][str(b)] for b in buckets if str(b) in held["buckets"]}
        by_folder: dict[str, list[str]] = {}
        for b, folder in wanted.items():
            by_folder.setdefault(folder, []).append(f"{self.root}/data/{folder}/{table}/bucket={b}")
        out = None
        for folder, paths in by_folder.items():
            part = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{folder}/{table}").parquet(*paths)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], schema)
        for column, value in held.get("defaults", {}).items():
            out = out.withColumn(column, F.coalesce(column, F.lit(value).cast(schema[column].dataType)))
        return out

    def ensure(self, schemas: dict[str, StructType], defaults: dict[str, dict] | None = None) -> bool:
        """Makes the state have these tables with these columns (and ``bucket``); returns whether anything was missing.

        Missing tables begin empty. Missing columns are added without a rewrite: files from before have nulls there, read as the column's
        default where it has one. Columns that the state has beyond these stay. Applied again it finds nothing to do.
        """
        base = self.manifest()
        new = {"version": uuid.uuid4().hex, "base": base["version"], "tables": {k: dict(v) for k, v in base["tables"].items()}}
        healed = False
        for name, schema in schemas.items():
            held = new["tables"].setdefault(name, {"schema": StructType([StructField("bucket", IntegerType())]).jsonValue(), "buckets": {}})
            fields = StructType.fromJson(held["schema"]).fields
            missing = [f for f in schema.fields if f.name not in {x.name for x in fields}]
            if missing or name not in base["tables"]:
                healed = True
                held["schema"] = StructType([*fields[:-1], *missing, fields[-1]]).jsonValue()
                wanted = (defaults or {}).get(name, {})
                held["defaults"] = held.get("defaults", {}) | {f.name: wanted[f.name] for f in missing if f.name in wanted}
        if healed:
            self.publish(new)
        return healed

    def prepare(self, tables: dict[str, DataFrame], changed: Iterable[int] | None = None, base: dict | None = None, order: dict[str, list[str]] | None = None) -> dict:
        """Writes the tables (each with ``bucket``) and gives the manifest that would put them in force.

        With ``changed``, only these buckets take their rows from ``tables``; a bucket without rows becomes empty.
        """
        base = base or self.manifest()
        changed = None if changed is None else list(changed)
        version = uuid.uuid4().hex
        new = {"version": version, "base": base["version"], "tables": {k: dict(v) for k, v in base["tables"].items()}}
        for name, df in tables.items():
            by = (order or {}).get(name, [])
            rows = by_bucket(df, self.buckets if changed is None else len(changed)).sortWithinPartitions("bucket", *by)
            rows.write.partitionBy("bucket").option("maxRecordsPerFile", 0).parquet(f"{self.root}/data/{version}/{name}")
            written = {str(b) for b in self._written(f"data/{version}/{name}")}
            old = {} if changed is None else base["tables"].get(name, {"buckets": {}})["buckets"]
            kept = {b: f for b, f in old.items() if int(b) not in set(changed or ())}
            fields = [f for f in df.schema.fields if f.name != "bucket"] + [df.schema["bucket"]]
            new["tables"][name] = {"schema": StructType(fields).jsonValue(), "buckets": kept | dict.fromkeys(written, version)}
            if changed is not None and (defaults := base["tables"].get(name, {}).get("defaults")):
                new["tables"][name]["defaults"] = defaults
        return new

    def _written(self, name: str) -> list[int]:
        return [int(n.partition("=")[2]) for n in self.files.names(f"{self.root}/{name}") if n.startswith("bucket=")]

    def publish(self, new: dict) -> str:
        """Puts a prepared manifest in force, if the state it was prepared on still is."""
        if self.manifest()["version"] != new["base"]:
            raise Conflict(f"{new['base'] or 'nothing'} is no longer in force")
        self.files.write(f"{self.root}/manifests/{new['version']}.json", json.dumps(new))
        self.files.write(f"{self.root}/pointers/{new['version']}", new["version"])
        self.files.replace(f"{self.root}/pointers/{new['version']}", f"{self.root}/CURRENT")
        return new["version"]

    def commit(self, tables: dict[str, DataFrame], changed: Iterable[int] | None = None, base: dict | None = None, order: dict[str, list[str]] | None = None) -> str:
        return self.publish(self.prepare(tables, changed, base, order))

    def intact(self) -> bool:
        """Whether there is a state in force and the folders of all its buckets are there."""
        held = self.manifest()
        folders = {f"{self.root}/data/{f}/{name}" for name, t in held["tables"].items() for f in t["buckets"].values()}
        return bool(held["version"]) and all(self.files.exists(f) for f in folders)

    def vacuum(self) -> list[str]:
        """Removes the folders that the state in force doesn't use; returns their names. No reader or writer may be under way."""
        held = self.manifest()
        used = {f for t in held["tables"].values() for f in t["buckets"].values()}
        gone = []
        if self.files.exists(f"{self.root}/data"):
            for name in self.files.names(f"{self.root}/data"):
                if name not in used:
                    gone.append(name)
                    self.files.delete(f"{self.root}/data/{name}")
        return gone
