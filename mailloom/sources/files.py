"""Small control files beside the tables, by Hadoop's file systems: any path that Spark writes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where it does not exist."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(1 << 20)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; false where one of this name is there already."""
    fs, where = _at(spark, path)
    if fs.exists(where):
        return False
    try:
        stream = fs.create(where, False)
    except Exception as error:  # lost the race between the test and here
        if "AlreadyExists" in str(error):
            return False
        raise
    stream.write(text.encode())
    stream.close()
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
