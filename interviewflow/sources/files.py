"""Small files beside tables: logs, pointers and ledgers, through the file system of their path.

Everything here is a few bytes or a few names; tables are read and written by Spark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark opens it by, for programs that have another default."""
    return _system(spark, path).makeQualified(_path(spark, path)).toString()


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder. Names that begin with a dot are left out."""
    if not exists(spark, folder):
        return []
    names = [s.getPath().getName() for s in _system(spark, folder).listStatus(_path(spark, folder))]
    return sorted(n for n in names if not n.startswith("."))


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file that others see whole or not at all: a hidden one is renamed over it."""
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    stream = _system(spark, hidden).create(_path(spark, hidden), True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    context = fs.FileContext.getFileContext(_system(spark, path).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(_path(spark, hidden), _path(spark, path), over)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file, or a folder with all in it; nothing if there is none."""
    _system(spark, path).delete(_path(spark, path), True)
