"""Folder listing and removal on whatever file system the store lives on."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _open(spark, path)
    return fs.exists(target)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Sorted values of the `column=value` folders directly below a path."""
    target, fs = _open(spark, path)
    if not fs.exists(target):
        return []
    prefix = f"{column}="
    names = [status.getPath().getName() for status in fs.listStatus(target) if status.isDirectory()]
    return sorted(name[len(prefix):] for name in names if name.startswith(prefix))


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the files directly below a path, drafts left out."""
    target, fs = _open(spark, path)
    if not fs.exists(target):
        return []
    found = [status.getPath().getName() for status in fs.listStatus(target) if status.isFile()]
    return sorted(name for name in found if not name.startswith("."))


def read(spark: SparkSession, path: str) -> str | None:
    """Text of a small file; None if it is gone."""
    target, fs = _open(spark, path)
    try:
        stream = fs.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
    except Py4JJavaError as failure:
        if "FileNotFoundException" in str(failure.java_exception):
            return None
        raise


def publish(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Put a small file in place whole, unless the name is taken; says whether it did."""
    target, fs = _open(spark, f"{folder}/{name}")
    draft, _ = _open(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), target.toUri().getPath())  # a local rename would overwrite
        else:
            rename_new(spark, draft, target)
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)


def rename_new(spark: SparkSession, source, target) -> None:
    """Rename that fails if the target exists."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    options = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    files = hadoop.FileContext.getFileContext(target.toUri(), context._jsc.hadoopConfiguration())
    try:
        files.rename(source, target, options)
    except Py4JJavaError as failure:
        if "FileAlreadyExists" in str(failure.java_exception):
            raise FileExistsError(str(target)) from None
        raise


def remove(spark: SparkSession, path: str) -> bool:
    target, fs = _open(spark, path)
    return fs.delete(target, True)
