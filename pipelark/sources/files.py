"""Folders and small files wherever Spark can read them (local, object stores, Azure)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..errors import CatalogError


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, fetched in one call however many there are."""
    system, place = _place(spark, folder)
    if not system.exists(place):
        raise CatalogError(f"folder {folder} doesn't exist")
    paths = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(system.listStatus(place))
    listed = spark._jvm.scala.runtime.ScalaRunTime.stringOf(paths)  # Array(path, path, ...)
    return [path.rpartition("/")[2] for path in listed.removeprefix("Array(").removesuffix(")").split(", ")]


def content(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    system, place = _place(spark, path)
    if not system.exists(place):
        raise CatalogError(f"file {path} doesn't exist")
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str) -> None:
    """A small file with a text, instead of one that is there."""
    system, place = _place(spark, path)
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Take a folder away, unless the session has ended."""
    if spark.sparkContext._jsc is not None:
        system, place = _place(spark, path)
        system.delete(place, True)


def first_record(spark: SparkSession, path: str) -> str | None:
    """A CSV file's first record, with line ends that stand in quotes; None if the file is empty."""
    system, place = _place(spark, path)
    stream = system.open(place)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        record = None
        while (line := reader.readLine()) is not None:
            record = line if record is None else f"{record}\n{line}"
            if record.count('"') % 2 == 0:
                break
        return record
    finally:
        stream.close()


def fields(record: str) -> int:
    """How many fields a record has."""
    # A field is quoted if a quote begins it; in quotes, two quotes are one.
    return len(re.findall(r'(?:^|,)(?:"(?:[^"]|"")*"[^,]*|[^,]*)', record))
