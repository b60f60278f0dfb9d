"""Small files and folders through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

from ..functions.status import InvalidArgument


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir. Without that setting, a folder of this
    machine is only used if the whole of Spark runs on it (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerline')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.base = base.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def full(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes, sync: bool = True) -> None:
        """Writes under another name and renames, so that readers see all or nothing; with sync, it is on disk before that."""
        part = f"{name}.part"
        stream = self.fs.create(self.path(part), True)
        stream.write(bytearray(data))
        if sync:
            stream.hsync()
        stream.close()
        if self.exists(name):
            self.fs.delete(self.path(name), False)
        if not self.fs.rename(self.path(part), self.path(name)):
            raise OSError(f"can't rename {part}")

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
