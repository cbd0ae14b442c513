"""Counters per (second, service, level), and per wider buckets."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.timestamps import second_of

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def rollup_1s(logs: DataFrame, *carried: str) -> DataFrame:
    """One row per second, service and level. Partial counts form before the
    shuffle, so a hot service or second moves as one row per task."""
    like = logs.schema["timestamp"].dataType
    return logs.groupBy(
        second_of(F.col("timestamp"), like).alias("bucket_start"), "service", "level", *carried
    ).agg(F.count("*").alias("count"))


def merge_deltas(deltas: DataFrame, *carried: str) -> DataFrame:
    """Counts are additive: per-batch deltas sum to one row per key."""
    return deltas.groupBy("bucket_start", "service", "level", *carried).agg(F.sum("count").alias("count"))


def coarser(counters: DataFrame, seconds: int, *carried: str) -> DataFrame:
    """Counters of wider buckets, a divisor of the day, from finer ones."""
    start = F.window("bucket_start", f"{seconds} seconds")["start"]
    return merge_deltas(counters.withColumn("bucket_start", start), *carried)


def split_range(since: datetime, until: datetime, widths: list[int]) -> list[list[tuple[datetime, datetime]]]:
    """[since, until) cut into pieces of whole buckets, as wide as they fit: ranges for what no bucket
    covers, then for each width (ascending, each a multiple of the one before). Empty ones are left out."""
    found: list[list[tuple[datetime, datetime]]] = []
    for width in widths:
        low, high = aligned(since, width, up=True), aligned(until, width)
        if low is None or low >= high:
            break
        found.append([(since, low), (high, until)])
        since, until = low, high
    found.append([(since, until)])
    found += [[] for _ in range(len(widths) + 1 - len(found))]
    return [[(start, end) for start, end in ranges if start < end] for ranges in found]


def aligned(moment: datetime, width: int, up: bool = False) -> datetime | None:
    """The start of the bucket of so many seconds that holds the moment, or with `up` the first at or
    after it; None if that lies beyond the last year."""
    past = (moment - EPOCH) % timedelta(seconds=width)
    if not past:
        return moment
    try:
        return moment - past + timedelta(seconds=width if up else 0)
    except OverflowError:
        return None
