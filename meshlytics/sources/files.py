"""Names of files and folders, asked from the file system that a path is on; no rows are read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all that is in it."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, where = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern."""
    fs, where = _at(spark, pattern)
    return [x.getPath().toString() for x in fs.globStatus(where) or []]
