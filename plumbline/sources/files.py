"""The few things asked of a file system itself, on the driver, through the one Spark is configured with."""

from __future__ import annotations

from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def first_bytes(spark: SparkSession, path: str, size: int) -> bytes:
    """Spark's own readers drop a byte order mark unseen."""
    system, location = _located(spark, path)
    stream = system.open(location)
    try:
        bounded = spark.sparkContext._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that must not exist yet; of any number of writers exactly one is told True.

    That holds where the file system creates files atomically: HDFS, object stores with
    conditional writes, and local folders, for which Spark's own class looks first and creates
    then, so the operating system is asked instead.
    """
    system, location = _located(spark, path)
    if system.getScheme() == "file":
        place = Path(location.toUri().getPath())
        place.parent.mkdir(parents=True, exist_ok=True)
        try:
            with place.open("x") as file:
                file.write(text)
        except FileExistsError:
            return False
        return True
    try:
        stream = system.create(location, False)
    except Py4JJavaError:
        if system.exists(location):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    system, location = _located(spark, path)
    return first_bytes(spark, path, 1 << 16).decode() if system.exists(location) else None


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    system, location = _located(spark, path)
    return [entry.getPath().getName() for entry in system.listStatus(location)] if system.exists(location) else []


def read_whole(spark: SparkSession, path: str) -> str | None:
    """A text that this library wrote itself, of any length; None if there is none."""
    system, location = _located(spark, path)
    if not system.exists(location):
        return None
    return first_bytes(spark, path, system.getFileStatus(location).getLen()).decode()


def modified(spark: SparkSession, path: str) -> list[tuple[str, int, float]]:
    """(name, bytes, seconds since 1970 of the last change) of what is in a folder."""
    system, location = _located(spark, path)
    found = system.listStatus(location) if system.exists(location) else []
    return [(e.getPath().getName(), e.getLen(), e.getModificationTime() / 1000) for e in found]


def remove(spark: SparkSession, path: str) -> None:
    system, location = _located(spark, path)
    system.delete(location, True)
