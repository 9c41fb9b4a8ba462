"""Small files that name what counts: written whole, put into place once, never replaced."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has taken the place."""


class Folder:
    """JSON files below a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    @property
    def fs(self):
        return self.path().getFileSystem(self.conf)

    def names(self, below: str = "") -> list[str]:
        at = self.path(below)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> dict:
        """The content of a file; one that is no JSON object is an error."""
        if not self.fs.exists(self.path(name)):
            raise FileNotFoundError(name)
        stream = self.fs.open(self.path(name))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError(f"{name} is no object")
        return found

    def _write(self, content: dict) -> str:
        part = f".{uuid.uuid4().hex}"
        out = self.fs.create(self.path(part), True)
        out.write(bytearray(json.dumps(content, ensure_ascii=False, sort_keys=True).encode()))
        out.close()
        return part

    def _move(self, part: str, name: str, *how) -> None:
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, len(how))
        for i, x in enumerate(how):
            options[i] = x
        self.fs.mkdirs(self.path(name).getParent())
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf).rename(self.path(part), self.path(name), options)

    def commit(self, name: str, content: dict) -> None:
        """Put a file into a place that is free; Conflict if another writer was faster."""
        part = self._write(content)
        try:
            self._move(part, name)
        except Exception as e:  # the reason comes from the JVM
            self.fs.delete(self.path(part), False)
            if self.fs.exists(self.path(name)):
                raise Conflict(name) from e
            raise

    def point(self, name: str, content: dict) -> None:
        """Put a file into its place at once, whatever was there."""
        self._move(self._write(content), name, self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
