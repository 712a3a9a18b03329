"""Shared scratch tables: the points where a long plan is cut.

A cut is a Parquet table under the folder named by ``spark.checkpoint.dir``, so a
lost executor costs a re-read, not a recomputation. Parquet also keeps column
pruning and filter pushdown alive for the readers of the cut.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


ROW_GROUP_BYTES = 2 << 20  # a file is read by as many tasks as it has row groups: small ones spread work that is heavy for its bytes
METHOD_BYTES = 8000  # longer methods are never compiled by HotSpot

_own_folders: dict[str, str] = {}  # by application: where the session names no folder, as in tests


def shared_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="veilcell-")
    return _own_folders[application]


class Workspace:
    """Writes and re-reads the scratch tables of one run and tracks what it caches.

    ``drop`` removes the tables once the results that read them are stored.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = f"{(folder or shared_folder(spark)).rstrip('/')}/run-{uuid.uuid4().hex}"
        self._tables = 0
        self._cached: list[DataFrame] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self._tables += 1
        path = f"{self.folder}/{self._tables:04d}-{name}"
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def short_methods(self) -> Iterator[None]:
        """Meanwhile plans are compiled in parts where one method would be longer than the JVM compiles: it would be interpreted."""
        name, before = "spark.sql.codegen.hugeMethodLimit", self.spark.conf.get("spark.sql.codegen.hugeMethodLimit")
        self.spark.conf.set(name, min(int(before), METHOD_BYTES))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._cached.append(df)
        return df

    def release(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._cached.clear()

    def drop(self) -> None:
        """Removes the tables of this run from the shared folder."""
        self.release()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
