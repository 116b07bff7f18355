"""Lineage cuts that survive the loss of executors.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``.
Only where that setting is missing and Spark runs in one process (tests) is a local
temporary folder taken instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for single-process sessions."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="vellumic-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


_FOLDERS: set[str] = set()


def release(spark: SparkSession) -> None:
    """Delete all tables that this application keeps; nothing may read them any more."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), f"{shared_dir(spark)}/vellumic-{spark.sparkContext.applicationId}")


def _delete(jvm, settings, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(settings).delete(path, True)


def _at_exit(jvm, settings, folder: str) -> None:
    """Also behind a session that was stopped, as long as its Java process is there."""
    try:
        _delete(jvm, settings, folder)
    except Exception:  # it has gone
        pass


class Scratch:
    """Tables written below :func:`shared_dir`, reread without lineage and with known sizes.

    They lie in one folder for each application, which owns them: it is deleted when the
    driver's Python ends or by :func:`release`, since results are read lazily and nothing here
    can tell when a table is read for the last time. Where an operator can, because all that
    it returns lies elsewhere, it keeps tables in a ``with`` block, behind which they go. Only
    a driver that is killed leaves its folder behind.
    """

    def __init__(self, spark: SparkSession, name: str):
        folder = f"{shared_dir(spark)}/vellumic-{spark.sparkContext.applicationId}"
        if folder not in _FOLDERS:
            _FOLDERS.add(folder)
            atexit.register(_at_exit, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
        self.spark = spark
        self.base = f"{folder}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._drop(self.base)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return the table as read back."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that :meth:`keep` wrote and nothing reads any more."""
        self._drop(df._scratch_path)

    def _drop(self, folder: str) -> None:
        _delete(self.spark._jvm, self.spark._jsc.hadoopConfiguration(), folder)
