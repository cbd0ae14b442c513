"""Request bodies as (request_id, body, received_at) rows, at rest or as a stream.

received_at is part of the data, never the clock of the job, so that taking the
same input twice gives the same verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.schema import REQUEST_SCHEMA


def read_requests(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.schema(REQUEST_SCHEMA).format(file_format).load(path)


def stream_requests(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
) -> DataFrame:
    """The same rows as a stream. The limits bound a micro-batch; what is beyond
    them waits in the folder."""
    reader = spark.readStream.schema(REQUEST_SCHEMA).format(file_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.load(path)


def request_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One request body per text file; arrival is the file's modification time."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.option("wholetext", True)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("request_id"),
            F.col("value").alias("body"),
            F.col("_metadata.file_modification_time").alias("received_at"),
        )
    )
