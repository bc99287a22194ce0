"""Intermediate tables in the folder that all executors share.

A written table cuts lineage and outlives any executor.  The folder is the
session's ``spark.checkpoint.dir``.  Only a local session, whose tasks all run on
this machine, may leave it unset and gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Lets Spark delete the shuffle files of a write once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; this process's own where none is set and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="spark-scratch-")
    return _OWN["dir"]


class Scratch:
    """Tables of one operator call, each under a path of its own.

    An operator drops what it won't read again.  What its lazy result still reads
    stays in the shared folder, for its owner to clear after the result is used.
    A write sets a setting of the whole session for as long as it takes, so writes of
    two threads in one session may undo each other's (files are then cleaned later);
    dropping needs a classic session, with a JVM at hand.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet, in a folder for each value of ``partition_by`` if given, and return the written table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, partitionBy=partition_by)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by :meth:`save` that nothing will read again."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path and path.startswith(self.root):
                jvm = self.spark.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
