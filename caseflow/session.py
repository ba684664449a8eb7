"""Session helpers: the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the session.

    Only a local session without one gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        folder = current if current else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_scopes: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    return "/".join([_own_folder(spark), *_scopes, f"{label}-{uuid.uuid4().hex}"])


@contextlib.contextmanager
def scratch_scope(label: str):
    """Intermediate tables named within go to a folder of their own, so that they can be deleted together; yields its name."""
    _scopes.append(f"{label}-{uuid.uuid4().hex}")
    try:
        yield "/".join(_scopes)
    finally:
        _scopes.pop()


def drop_scratch(spark: SparkSession, name: str) -> None:
    """Delete a table (its path) or a scope (its name) that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name if name.startswith(_own_folder(spark)) else f"{_own_folder(spark)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this package; once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        where = os.path.join(tempfile.mkdtemp(prefix="spark-"), os.path.basename(top))
        sc.addPyFile(shutil.make_archive(where, "zip", os.path.dirname(top), os.path.basename(top)))
        _shipped.add(sc.applicationId)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Call it when their results have been consumed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor does not replay what led to it, later
    uses do not derive it again, and the planner knows its real size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
