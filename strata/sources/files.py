"""Small files of an installation, through the file system that its root names.

Local roots use the operating system, all others Hadoop's FileContext in Spark's JVM.
``write_new`` makes a file appear whole, or fails if it is there: that is the only lock
there is. It needs a rename that is atomic and never replaces, so roots on stores without
one (object stores) are refused.
"""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from ..errors import FEATURE_NOT_SUPPORTED, StrataError

#: Schemes whose rename is atomic and fails if the target is there.
ATOMIC_RENAME = ("hdfs", "viewfs", "abfs", "abfss", "ofs", "o3fs")


class LocalFiles:
    def __init__(self, root: str):
        self.root = root.removeprefix("file://")

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def read(self, name: str) -> bytes:
        with open(self.path(name), "rb") as f:
            return f.read()

    def write_new(self, name: str, data: bytes) -> bool:
        path = self.path(name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{os.getpid()}.{id(data)}.part"
        with open(part, "wb") as f:
            f.write(data)
        try:
            os.link(part, path)  # whole or not at all
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True

    def put(self, name: str, data: bytes) -> None:
        path = self.path(name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            f.write(data)
        os.replace(f"{path}.part", path)

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(n for n in os.listdir(self.path(folder)) if not n.endswith(".part"))
        except FileNotFoundError:
            return []

    def exists(self, name: str) -> bool:
        return os.path.exists(self.path(name))

    def drop(self, name: str) -> None:
        path = self.path(name)
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.unlink(path)


class HadoopFiles:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root, spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _aside(self, name: str, data: bytes):
        """``data`` in a new file beside ``name``."""
        path = self._path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(path, False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return path

    def _rename(self, part, name: str, how) -> bool:
        from py4j.protocol import Py4JJavaError

        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = how
        try:
            self.context.rename(part, self._path(name), options)
        except Py4JJavaError as e:
            self.fs.delete(part, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def write_new(self, name: str, data: bytes) -> bool:
        if self.exists(name):
            return False
        return self._rename(self._aside(name, data), name, self.jvm.org.apache.hadoop.fs.Options.Rename.NONE)

    def put(self, name: str, data: bytes) -> None:
        self._rename(self._aside(name, data), name, self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE)

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(n for s in self.fs.listStatus(self._path(folder)) if not (n := s.getPath().getName()).endswith(".part"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def open_files(spark: SparkSession, root: str) -> LocalFiles | HadoopFiles:
    root = root.rstrip("/")
    scheme = urlparse(root).scheme
    if scheme in ("", "file"):
        return LocalFiles(root)
    if scheme not in ATOMIC_RENAME:
        raise StrataError(f"{scheme} has no atomic rename, which commits need", sqlstate=FEATURE_NOT_SUPPORTED, hint=f"use one of {', '.join(ATOMIC_RENAME)}")
    return HadoopFiles(spark, root)
