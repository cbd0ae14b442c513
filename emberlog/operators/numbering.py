"""Consecutive numbers over a whole frame in a given order, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import scratch_dir

_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number


def numbered(frame: DataFrame, *order: str | Column, column: str = "n") -> DataFrame:
    """`frame` with `column`, the row's place from 0 in ascending or given `order`.

    Rows are range-sorted once and written to the shared scratch folder with their place in their
    partition; rows are counted per partition, and the running totals, one row per partition, are
    joined back. Rows equal in `order` are numbered in any order, but each gets its own number, and
    many equal rows are spread over partitions. An empty frame stays empty.
    """
    spark = frame.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = frame.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = placed.withColumn("_place", F.monotonically_increasing_id())
    path = scratch_dir(spark, "numbered")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_place", _ROW_BITS))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_part").agg(F.count("*").alias("rows")).select("_part", before.alias("_before"))
    number = F.col("_before") + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return placed.join(F.broadcast(counts), "_part").withColumn(column, number).drop("_part", "_place", "_before")
