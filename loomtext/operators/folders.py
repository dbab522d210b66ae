"""Folders of tables: names in the file system that Spark writes to, and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomtext-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, none if it isn't there."""
    fs, path = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def there(spark: SparkSession, folder: str) -> bool:
    fs, path = _path(spark, folder)
    return fs.exists(path)


def mark(spark: SparkSession, file: str) -> None:
    """Makes an empty file; fails if it is there, so one of two writers of a name wins."""
    fs, path = _path(spark, file)
    fs.create(path, False).close()


def delete(spark: SparkSession, folder: str) -> None:
    fs, path = _path(spark, folder)
    fs.delete(path, True)


def written(spark: SparkSession, folder: str) -> int:
    """Bytes of a folder and all below it."""
    fs, path = _path(spark, folder)
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0
