"""Small files and renames in any store that Spark reaches, by its own file system classes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The file system that ``root`` lies in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted."""
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(folder)))

    def matching(self, pattern: str) -> list[str]:
        """Paths of the files that a glob matches."""
        found = self.fs.globStatus(self.path(pattern))
        return [f.getPath().toString() for f in found or [] if f.isFile()]

    def read(self, name: str, most: int = 16_000_000) -> str:
        """A small file; one over ``most`` bytes is refused."""
        if self.fs.getFileStatus(self.path(name)).getLen() > most:
            raise ValueError(f"{name} has over {most} bytes")
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def join(self, parts: list[str], target: str) -> None:
        """One file from the bytes of several, in order; a buffer's worth is held at a time."""
        out = self.fs.create(self.path(target), True)
        try:
            for part in parts:
                stream = self.fs.open(self.path(part))
                try:
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65_536, False)
                finally:
                    stream.close()
        finally:
            out.close()

    def replace(self, source: str, target: str) -> None:
        """Renames over the target in one step."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        uri = self.fs.makeQualified(self.path(target)).toUri()
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.conf).rename(self.path(source), self.path(target), how)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
