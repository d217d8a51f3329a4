"""Small files and folders through Hadoop's file systems, so that any storage Spark reaches will do."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _store(self, name: str = ""):
        return self._path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self._store(name).exists(self._path(name))

    def make(self, name: str) -> None:
        self._store(name).mkdirs(self._path(name))

    def remove(self, name: str) -> None:
        self._store(name).delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(x.getPath().getName() for x in self._store(name).listStatus(self._path(name)))

    def size(self, name: str) -> int:
        return self._store(name).getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self._store(name).open(self._path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Written beside and renamed over, so readers see the old or the new one."""
        folder, _, last = name.rpartition("/")
        beside = f"{folder}/_{last}.new" if folder else f"_{last}.new"  # a name that Spark's readers pass over
        stream = self._store(name).create(self._path(beside), True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(beside).getFileSystem(self.conf).getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(beside), self._path(name), options)
