"""Shared-folder storage for intermediate tables.

Iterative jobs cut their lineage by writing a table and reading it back. The
folder comes from ``spark.checkpoint.dir``, so every executor sees it and a lost
executor costs no more than the tasks it was running. Reading the table back
also gives the optimizer its true size, which decides between broadcast and
shuffle joins.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_LEFT: dict[str, Workspace] = {}


def _root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if sc.applicationId not in _LOCAL_ROOTS:
        root = tempfile.mkdtemp(prefix="pointlake-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _LOCAL_ROOTS[sc.applicationId] = root
    return _LOCAL_ROOTS[sc.applicationId]


class Workspace:
    """A fresh folder under the shared root; one per job.

    Results that are still to be read keep it; what no job has deleted goes when the
    application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{_root(spark)}/work-{uuid.uuid4().hex}"
        self._numbers = itertools.count()
        _LEFT[self.path] = self

    def location(self, name: str) -> str:
        return f"{self.path}/{next(self._numbers):03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a scan of the written table."""
        target = self.location(name)
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def delete(self) -> None:
        """Remove the folder once no DataFrame reads from it any more."""
        sc = self.spark.sparkContext
        stopped = sc._jsc is None
        conf = sc._jvm.org.apache.hadoop.conf.Configuration() if stopped else sc._jsc.hadoopConfiguration()
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)
        _LEFT.pop(self.path, None)


@atexit.register
def _delete_left() -> None:
    for work in list(_LEFT.values()):
        with contextlib.suppress(Exception):  # the JVM may have ended already
            work.delete()
