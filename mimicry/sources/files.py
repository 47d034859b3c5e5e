"""Names, deletions and exclusive creations in any file system that Spark can reach.

Only the driver calls these, for a handful of folders and small files; rows are read and
written by Spark.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors.exceptions.base import PySparkException
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> object:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str) -> object:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders and files below ``path``; none where it does not exist."""
    system = _system(spark, path)
    if not system.exists(_path(spark, path)):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(_path(spark, path)))


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole or not at all; False if there already is one of that name.

    The text is written beside it and renamed, which refuses to replace a file (atomically on
    file systems whose rename is atomic, as HDFS's and local ones).
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = _path(spark, path)
    draft = _path(spark, f"{path.rpartition('/')[0]}/.{uuid4().hex}")
    out = _system(spark, path).create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    plain = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        plain.rename(_qualified(spark, draft), _qualified(spark, target), options)
    except (Py4JJavaError, PySparkException):
        _system(spark, path).delete(draft, False)
        if not exists(spark, path):
            raise
        return False
    return True


def _qualified(spark: SparkSession, path: object) -> object:
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)


def read_small(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
