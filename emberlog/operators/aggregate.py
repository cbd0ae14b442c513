"""Counts per tumbling time bucket, from raw rows or from the counters."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.timestamps import ceil_second, floor_second, render_millis
from emberlog.operators.filters import (
    attribute_equals,
    equals,
    message_contains,
    time_range,
    where_all,
)
from emberlog.plans.options import AggregateOptions
from emberlog.schema import BUCKETS


def _bin(ts: str, options: AggregateOptions) -> Column:
    """Bucket start. Windows align to the epoch, a UTC midnight, as does every
    supported bucket; they floor before the epoch and ignore the session zone."""
    return F.window(F.col(ts), BUCKETS[options.bucket])["start"].alias("start")


def _group(options: AggregateOptions) -> Column:
    chosen = F.col(options.group_by) if options.group_by else F.lit(None).cast("string")
    return chosen.alias("group")


def _count_by_bucket(rows: DataFrame, ts: str, count: Column, options: AggregateOptions) -> DataFrame:
    keys = [_bin(ts, options)] + ([_group(options)] if options.group_by else [])
    counted = rows.groupBy(*keys).agg(count.alias("count"))
    if not options.group_by:
        return counted.select("start", _group(options), "count").orderBy("start")
    return counted.select("start", "group", "count").orderBy("start", "group")


def aggregate_raw(logs: DataFrame, options: AggregateOptions) -> DataFrame:
    """(start, group, count) over raw rows; empty buckets are absent."""
    rows = where_all(
        logs,
        time_range(logs, "timestamp", options.since, options.until)
        + equals(options.service, options.level)
        + message_contains(options.q, options.literal_q)
        + attribute_equals(logs, options.attrs),
    )
    return _count_by_bucket(rows, "timestamp", F.count("*"), options)


def aggregate_rollup(logs: DataFrame, rollup: DataFrame, options: AggregateOptions) -> DataFrame:
    """The same answer from 1-second counters plus the raw rows of the two partial
    seconds at the ends; bounds are exact to the microsecond."""
    first, last = ceil_second(options.since), floor_second(options.until)
    keep = equals(options.service, options.level)

    def raw(start: datetime, end: datetime) -> DataFrame:
        rows = where_all(logs, time_range(logs, "timestamp", start, end) + keep)
        return rows.select(F.col("timestamp").alias("ts"), "service", "level", F.lit(1).cast("bigint").alias("c"))

    def counters(start: datetime, end: datetime) -> DataFrame:
        rows = where_all(rollup, time_range(rollup, "bucket_start", start, end) + keep)
        return rows.select(F.col("bucket_start").alias("ts"), "service", "level", F.col("count").alias("c"))

    if first < last:
        pieces = [(raw, options.since, first), (counters, first, last), (raw, last, options.until)]
    else:
        pieces = [(raw, options.since, options.until)]
    # An empty piece is left out; an empty range keeps one so that it still has columns.
    branches = [read(start, end) for read, start, end in pieces if start < end]
    branches = branches or [raw(options.since, options.until)]
    return _count_by_bucket(reduce(DataFrame.unionAll, branches), "ts", F.sum("c"), options)


def aggregate_pieces(
    pieces: list[tuple[DataFrame, str, list[tuple[datetime, datetime]]]], options: AggregateOptions
) -> DataFrame:
    """The same answer from rows and counters that together cover the range once: each piece is a
    frame, its time column and the ranges it answers for; a frame without `count` holds raw rows."""
    branches = []
    for frame, ts, ranges in pieces:
        inside = reduce(or_, [reduce(and_, time_range(frame, ts, start, end)) for start, end in ranges])
        rows = where_all(frame, [inside, *equals(options.service, options.level)])
        count = F.col("count") if "count" in frame.columns else F.lit(1).cast("bigint")
        branches.append(rows.select(F.col(ts).alias("ts"), "service", "level", count.alias("c")))
    return _count_by_bucket(reduce(DataFrame.unionAll, branches), "ts", F.sum("c"), options)


def aggregate_logs(
    logs: DataFrame, options: AggregateOptions, rollup: DataFrame | None = None
) -> DataFrame:
    """Counters whenever they can answer exactly, raw rows otherwise."""
    if rollup is not None and options.counted_by_rollup:
        return aggregate_rollup(logs, rollup, options)
    return aggregate_raw(logs, options)


def rendered_buckets(buckets: DataFrame) -> DataFrame:
    """Response shape: millisecond bucket start, group null without group_by."""
    return buckets.select(render_millis(F.col("start")).alias("start"), "group", "count")
