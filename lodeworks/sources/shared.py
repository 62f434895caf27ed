"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions, by application; they go when the process ends.
_LOCAL: dict[str, str] = {}
#: Paths made within the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder in ``spark.checkpoint.dir``; only a local session gets one of its own where it is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = spark.sparkContext.applicationId
        if own not in _LOCAL:
            made = tempfile.mkdtemp(prefix="lodeworks-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _LOCAL[own] = "file://" + made
        place = _LOCAL[own]
    return place.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for s in _SCOPES[-1:]:
        s.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that were settled within are deleted at its end: read or write the results inside.

    Without a scope they stay in the shared folder, since a result may be read as long as its session lives; only the
    folder of a local session without ``spark.checkpoint.dir`` goes by itself, with the process.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            Files(spark, path).delete(path)


def settle(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


class Files:
    """Hadoop's file system of a path, for the few driver-side steps on names, never on rows."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_file(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isFile()

    def move(self, path: str, to: str) -> None:
        """Rename below the same file system; the folders above ``to`` are made."""
        target = self._path(to)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(path), target):
            raise OSError(f"could not move {path} to {to}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, path: str, text: str) -> None:
        """Write beside the place, then rename: the file is there whole or not at all."""
        draft = self._path(path + ".draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(self._path(path), False)
        if not self._fs.rename(draft, self._path(path)):
            raise OSError(f"could not commit {path}")
