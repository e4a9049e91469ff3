"""Small files at any URI that Spark's file systems know (file:, hdfs:, s3a: ...)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


class Files:
    """Paths are relative to a root. put() creates and never overwrites."""

    def __init__(self, spark: SparkSession, root: str):
        jvm, context = spark.sparkContext._jvm, spark.sparkContext
        self.spark, self.root = spark, root.rstrip("/")
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}" if p else self.root)
        self._fs = self._path("").getFileSystem(context._jsc.hadoopConfiguration())
        self._streams = jvm.org.apache.commons.io.IOUtils

    def uri(self, path: str) -> str:
        return f"{self.root}/{path}"

    def has(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def get(self, path: str) -> bytes:
        if not self.has(path):
            raise KeyError(path)
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._streams.toByteArray(stream))
        finally:
            stream.close()

    def put(self, path: str, data: bytes) -> bool:
        """False if the path is taken: of several writers exactly one gets True."""
        try:
            stream = self._fs.create(self._path(path), False)
        except Exception as e:
            if self.has(path):
                return False
            raise e
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return True

    def names(self, path: str) -> list[str]:
        """What a folder holds, in order."""
        if not self.has(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def walk(self, path: str, suffix: str) -> Iterator[str]:
        """Names, without the suffix, of the files below a folder."""
        if not self.has(path):
            return
        found = self._fs.listFiles(self._path(path), True)
        while found.hasNext():
            name = found.next().getPath().getName()
            if name.endswith(suffix):
                yield name[: len(name) - len(suffix)]

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)
