"""Small files and folders of a shared file system, through the session's own file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str, folders: bool) -> list[str]:
    _, where, system = _at(spark, path)
    if not system.exists(where):
        return []
    return sorted(f.getPath().getName() for f in system.listStatus(where)
                  if f.isDirectory() == folders and not f.getPath().getName().startswith("."))


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of a folder; none if it does not exist."""
    return _listed(spark, path, False)


def folders(spark: SparkSession, path: str) -> list[str]:
    return _listed(spark, path, True)


def read_file(spark: SparkSession, path: str) -> str:
    _, where, system = _at(spark, path)
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Give a file new contents in one step: they are written beside it and renamed over it."""
    folder, name = path.rsplit("/", 1)
    hadoop, part, system = _at(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = system.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = hadoop.FileContext.getFileContext(
        part.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(part, hadoop.Path(path), options)


def remove(spark: SparkSession, path: str) -> None:
    _, where, system = _at(spark, path)
    system.delete(where, True)
