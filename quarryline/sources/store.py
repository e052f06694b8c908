"""Folders on storage that driver and executors share, by Hadoop's file systems."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder's path under spark.checkpoint.dir; only local mode may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


class Folder:
    """Names below one path. All of this runs on the driver and moves no rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What is directly below; nothing where there is no such folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self._fs.exists(self._at(name)) else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def read_json(self, name: str):
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit_json(self, name: str, value) -> None:
        """Make a file appear whole or not at all; FileExistsError where there is one of that name."""
        part = f".{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(part))
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(part).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), self._conf)
        try:
            context.rename(self._at(part), self._at(name), self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.delete(part)
            raise FileExistsError(f"{self.path}/{name}") from e
