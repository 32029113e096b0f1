"""Stores that are rewritten: each write makes a new version beside the old ones, and a pointer
names the current one. A path that is being read is never overwritten, and a reader keeps the
version it has begun with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.eventlog import EventLog, restamped
from ..schema import KEPT_ON_DISK


class VersionedStore:
    """A table in ``root``: ``v-*`` folders of Parquet and ``CURRENT~n`` markers, the highest counts.

    A marker's name is the version's number alone, so of two writers of one version the file system
    lets one create it; the marker holds the folder's name. One that is still empty doesn't count yet.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, str]]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        found = ((int(n.split("~")[1]), self._held(n)) for n in names if n.startswith("CURRENT~"))
        return sorted((number, folder) for number, folder in found if folder)

    def _held(self, marker: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{marker}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _marked(self, number: int, folder: str) -> bool:
        """Creates the version's marker; False where there is one."""
        try:
            stream = self._fs.create(self._path(f"{self.root}/CURRENT~{number:09d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(folder.encode()))
        finally:
            stream.close()
        return True

    def version(self) -> int:
        return max(self._pointers(), default=(0, ""))[0]

    def read(self) -> DataFrame:
        pointers = self._pointers()
        if not pointers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{pointers[-1][1]}")

    def write(self, df: DataFrame) -> int:
        """Make ``df`` the current version; fails if another writer has made one meanwhile."""
        number, name = self.version() + 1, f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        if not self._marked(number, name):
            raise RuntimeError("another writer was faster")
        return number

    def refresh(self) -> DataFrame:
        """The current version as it is now; raises where none was ever written."""
        if not self.version():
            raise FileNotFoundError(self.root)
        return self.read()

    def change(self, edit: Callable[[DataFrame], DataFrame]) -> int:
        return self.write(edit(self.read()))

    def clear(self) -> int:
        return self.write(self.spark.createDataFrame([], self.schema))


class LogStore(VersionedStore):
    """An event log of bounded length."""

    def __init__(self, spark: SparkSession, root: str, schema: str, kept: int = KEPT_ON_DISK):
        super().__init__(spark, root, schema)
        self.kept = kept

    def append(self, rows: DataFrame) -> int:
        return self.change(lambda log: EventLog(log).append(EventLog(rows)).tail(self.kept).df)

    def replace(self, rows: DataFrame) -> int:
        return self.write(EventLog(rows).tail(self.kept).df)

    def replace_import(self, rows: DataFrame, now: float) -> int:
        """As :meth:`replace`, each row with ``now`` as its time, as if it had just been added."""
        return self.replace(restamped(rows, now))
