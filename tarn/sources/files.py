"""Small files in any store that Spark reaches: pointers, manifests, locks, notes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Files under one folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self.root = root.rstrip("/") or "/"
        self._fs = self._path("").getFileSystem(self._conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes, overwrite: bool = False) -> bool:
        """Writes a file; false if there is one and it may not be replaced."""
        try:
            stream = self._fs.create(self._path(name), overwrite)
        except Exception as error:
            if not overwrite and self.exists(name):
                return False
            raise error
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return True

    def replace(self, name: str, data: bytes) -> None:
        """Writes a file so that readers see the old one or the new one, whole."""
        self._moved(name, data, "OVERWRITE")

    def publish(self, name: str, data: bytes) -> bool:
        """Writes a file that readers see whole or not at all; false if there is one, which stays."""
        try:
            self._moved(name, data, "NONE")
        except Exception as error:
            if self.exists(name):
                return False
            raise error
        return True

    def _moved(self, name: str, data: bytes, rule: str) -> None:
        folder, _, own = name.rpartition("/")
        fresh = f"{folder}/.{own}.{uuid.uuid4().hex}".lstrip("/")
        self.create(fresh, data)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, 1)
        options[0] = getattr(rename, rule)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(self._path(fresh)), self._fs.makeQualified(self._path(name)), options)
        except Exception:
            self.remove(fresh)
            raise

    def names(self, folder: str, suffix: str = "") -> list[str]:
        """Files right in a folder, by name; hidden ones left out."""
        if not self.exists(folder):
            return []
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(folder)) if f.isFile()]
        return sorted(n for n in found if n.endswith(suffix) and not n.startswith("."))

    def folders(self, folder: str) -> list[str]:
        """Folders right in a folder, by name."""
        if not self.exists(folder):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(folder)) if f.isDirectory())

    def size(self, folder: str) -> int:
        """Bytes of all files in a folder; none if there is no such folder."""
        return self._fs.getContentSummary(self._path(folder)).getLength() if self.exists(folder) else 0

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
