"""Small files and folders through Hadoop's file system, so that a path means the same on the driver and on a cluster."""

from __future__ import annotations

import datetime
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Exists(RuntimeError):
    """There is a file of that name already."""


class Files:
    """What the driver does with small files below shared storage."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        rename, array = self.jvm.org.apache.hadoop.fs.Options.Rename, spark.sparkContext._gateway.new_array
        self.none, self.over = array(rename, 0), array(rename, 1)
        self.over[0] = rename.OVERWRITE

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def plain(self, path: str) -> str:
        """An absolute path without scheme and host."""
        return self._system(path).makeQualified(self._path(path)).toUri().getPath().rstrip("/")

    def modified(self, path: str) -> datetime.datetime:
        return datetime.datetime.fromtimestamp(self._system(path).getFileStatus(self._path(path)).getModificationTime() / 1000, datetime.timezone.utc)

    def exists(self, path: str) -> bool:
        return self._system(path).exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """The names in a folder, sorted; none if there is no folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._system(folder).listStatus(self._path(folder)))

    def read(self, path: str) -> str:
        """The text of a small file; OSError if it is not there, or not as it was written."""
        try:
            stream = self._system(path).open(self._path(path))
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise OSError(f"{path}: {e.java_exception}") from None

    def size(self, path: str) -> int:
        """The bytes of all files below a folder, or of a file."""
        return self._system(path).getContentSummary(self._path(path)).getLength()

    def replace(self, path: str, text: str) -> None:
        """A small file that is there whole, in place of one that may have been there."""
        self._write(path, text, self.over)

    def write_new(self, path: str, text: str) -> None:
        """A small file that is there whole or not at all; `Exists` if the name is taken."""
        self._write(path, text, self.none)

    def _write(self, path: str, text: str, how) -> None:
        part = self._path(f"{path}.{uuid.uuid4().hex}.part")
        out = self._system(path).create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        # Not FileSystem.rename, which may overwrite.
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self._system(path).getUri(), self.conf)
        try:
            context.rename(part, self._path(path), how)
        except Py4JJavaError as e:
            self.delete(part.toString())
            if "FileAlreadyExists" in str(e.java_exception):
                raise Exists(path) from None
            raise

    def move(self, path: str, target: str) -> None:
        """A file under another name; its folder is made, and a file of that name replaced."""
        system = self._system(path)
        system.mkdirs(self._path(target).getParent())
        where = self._path(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else system.getUri(), self.conf)
        context.rename(where, self._path(target), self.over)

    def delete(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)
