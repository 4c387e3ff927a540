"""Folders in whatever store Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def named(spark: SparkSession, folder: str, prefix: str, holding: str | None = None) -> list[str]:
    """Names in a folder that begin with `prefix` and, if asked, hold a file `holding`; none if there is no folder."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if n.startswith(prefix) and (holding is None or fs.exists(_fs(spark, f"{folder}/{n}/{holding}")[1])))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
