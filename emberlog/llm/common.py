"""Helpers shared by the operators: scratch tables, words, row keys."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import scratch_dir
from emberlog.sources import paths

#: Spark's setting by which an execution's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame's rows, written to the shared scratch folder and read back.

    This cuts the lineage: a lost executor afterwards costs its tasks, not the work before. Shuffle
    files of the write go with its end; else they stay until the driver collects its garbage.
    """
    spark = frame.sparkSession
    path = scratch_dir(spark, purpose)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def released(*frames: DataFrame) -> None:
    """Removes the tables of frames that `stored` returned and nothing reads any more."""
    for frame in frames:
        files = frame.inputFiles()
        if files:
            paths.remove(frame.sparkSession, files[0].rsplit("/", 1)[0])


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def sampled(frame: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About `rows` rows, those with the smallest hashes of `columns`, or all of a smaller frame; at
    most twice as many, should many rows share a hash. Nothing is sorted or sent to the driver."""
    count = frame.count()
    if count <= rows:
        return frame
    return frame.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < int(rows / count * (1 << 40))).limit(2 * rows)


def cells(batch, name: str) -> list:
    """A column of an Arrow batch as Python values, null strings as empty bytes."""
    column = batch.column(name)
    if str(column.type) in ("string", "large_string"):
        return [value or b"" for value in column.cast("binary").to_pylist()]
    return column.to_pylist()


class Shared:
    """An object sent to every executor once. Objects of this package go as their attributes, with
    the class beside the function that uses them, so executors need no copy of the package and
    hold one copy of the data."""

    def __init__(self, context: SparkContext, value):
        self._kind = type(value) if type(value).__module__.startswith(__package__) else None
        self._sent = context.broadcast(vars(value) if self._kind else value)

    def load(self):
        if self._kind is None:
            return self._sent.value
        found = self._kind.__new__(self._kind)
        found.__dict__.update(self._sent.value)
        return found
