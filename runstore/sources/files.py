"""Files through Spark's own file systems, so that a table may lie in any store that Spark reaches."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, data: bytes) -> bool:
        """Write a new file; False if it exists, and an error for anything else. It appears whole, and for one writer only.

        The data goes to a file of another name first. On a local disk a hard link gives it its name, elsewhere a rename that does
        not overwrite; either leaves nothing that could stop later writers if this one dies. Stores whose rename is not atomic
        (object stores) need a single writer.
        """
        target, part = self._path(name), self._path(f"{name}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp")
        if self.fs.exists(target):
            return False
        out = self.fs.create(part, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                nio = self.jvm.java.nio.file
                local = lambda p: nio.Path.of(self.jvm.java.net.URI("file", None, p.toUri().getPath(), None))
                nio.Files.createLink(local(target), local(part))
            else:
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.fs.delete(part, False)
        return True

    def writer(self, name: str):
        """An output stream to a new file, flushed as the store can: see `flushed`."""
        return self._raw().create(self._path(name), False)

    def _raw(self):
        """Without the check-sum layer of a local disk, which holds back what is flushed."""
        return self.fs.getRaw() if self.fs.getUri().getScheme() == "file" and hasattr(self.fs, "getRaw") else self.fs

    @staticmethod
    def flushed(stream, sync: bool = False) -> bool:
        """Hand what was written to the store; False if it can't take part of a file (it then must be closed)."""
        if not stream.hasCapability("hflush"):
            return False
        stream.hsync() if sync else stream.hflush()
        return True

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def list(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def delete(self, name: str) -> None:
        """Delete a file or folder of the root (the root itself: ""), or any by its full path."""
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(name) if "://" in name or name.startswith(("file:", "/")) else self._path(name), True)

    def data_files(self, name: str) -> DataFrame:
        """path, modified (seconds) of all files below a folder, listed by Spark."""
        path = f"{self.root}/{name}"
        if not self.fs.exists(self._path(name)):
            return self.spark.createDataFrame([], "path string, modified double")
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").cast("double").alias("modified"))
