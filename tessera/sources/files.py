"""Small files and folders on whatever file system the warehouse is on, by Hadoop's interface."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def changed(self, folder: str) -> dict[str, float]:
        """Names in a folder, with the time (seconds) of their last change."""
        path = self._path(folder)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(path)} if self.fs.exists(path) else {}

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self._path(name)).getLen()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a file that readers see whole or not at all; False if the name is taken.

        The rename is asked not to replace a file. HDFS does that in one step; on stores without such a rename
        (plain object stores) committers need one writer at a time or a committer that has it.
        """
        if self.fs.exists(self._path(name)):
            return False
        folder, _, last = name.rpartition("/")
        draft = self._path(f"{folder}/.{last}.{self.jvm.java.util.UUID.randomUUID().toString()}")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        never = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        never[0] = self.jvm.java.lang.Enum.valueOf(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "NONE")
        qualified = [self.fs.makeQualified(p) for p in (draft, self._path(name))]
        try:
            hadoop.FileContext.getFileContext(qualified[0].toUri(), self.conf).rename(*qualified, never)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
