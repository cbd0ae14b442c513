"""Newest-first search with keyset pages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from emberlog.functions.timestamps import ceil_second, floor_second, render_micros, render_millis
from emberlog.operators.filters import (
    attribute_equals,
    before_cursor,
    equals,
    message_contains,
    time_range,
    where_all,
)
from emberlog.operators.numbering import numbered
from emberlog.plans.options import SearchOptions, decode_cursor
from emberlog.schema import LOG_COLUMNS


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: str | None


def matching_logs(logs: DataFrame, options: SearchOptions) -> DataFrame:
    """All filters ANDed; none of them means the whole table."""
    return where_all(
        logs,
        equals(options.service, options.level)
        + time_range(logs, "timestamp", options.since, options.until)
        + message_contains(options.q, options.literal_q)
        + attribute_equals(logs, options.attrs)
        + before_cursor(logs, options.cursor),
    ).select(*LOG_COLUMNS)


def search_logs(logs: DataFrame, options: SearchOptions) -> DataFrame:
    """Matching rows by (timestamp, id) descending; limit None returns them all."""
    ordered = matching_logs(logs, options).orderBy(F.desc("timestamp"), F.desc("id"))
    return ordered if options.limit is None else ordered.limit(options.limit)


def cursor_column(timestamp: Column, row_id: Column) -> Column:
    """The opaque cursor of a row, at full microsecond precision."""
    return F.base64(F.concat(render_micros(timestamp), F.lit("|"), row_id.cast("string")).cast("binary"))


def search_page(logs: DataFrame, options: SearchOptions) -> Page:
    """One page and the cursor of the next, None on the last.

    One extra row is fetched to learn whether more follow; the cursor is that of
    the last row returned, so no row falls between pages.
    """
    return as_page(probe_rows(logs, replace(options, limit=options.limit + 1)), options.limit)


def probe_rows(logs: DataFrame, options: SearchOptions) -> list[Row]:
    """Collected rows, each with its cursor as a last column; at most `limit` of them."""
    cursor = cursor_column(F.col("timestamp"), F.col("id"))
    return search_logs(logs, options).withColumn("cursor", cursor).collect()


def as_page(rows: list[Row], limit: int) -> Page:
    log_row = Row(*LOG_COLUMNS)
    page = [log_row(*row[:-1]) for row in rows[:limit]]
    return Page(page, rows[limit - 1]["cursor"] if len(rows) > limit else None)


def iterate_pages(logs: DataFrame, options: SearchOptions) -> Iterator[Page]:
    """Follow the cursor until it is null, one job per page. `paged_logs` gives all pages in one."""
    while True:
        page = search_page(logs, options)
        yield page
        if page.next_cursor is None:
            return
        options = replace(options, cursor=decode_cursor(page.next_cursor))


def paged_logs(logs: DataFrame, options: SearchOptions) -> DataFrame:
    """Every page of a search at once: the matching rows with `page`, from 0, `limit` rows each in the
    search's order, and `n`, the row's place in the whole result.

    One range sort numbers the rows, whatever their count; none reach the driver. A cursor in the
    options starts the pages behind it.
    """
    found = numbered(matching_logs(logs, options), F.desc("timestamp"), F.desc("id"))
    return found.withColumn("page", F.floor(F.col("n") / options.limit).cast("int"))


def page_starts(paged: DataFrame, limit: int) -> DataFrame:
    """(page, cursor) of `paged_logs`: the cursor that opens each page, null for the first. With
    them a reader goes to any page at once, without those before."""
    last = F.col("n") % limit == limit - 1
    behind = paged.where(last).select((F.col("page") + 1).alias("page"), cursor_column(F.col("timestamp"), F.col("id")).alias("cursor"))
    pages = paged.where(F.col("n") % limit == 0).select("page")
    return pages.join(behind, "page", "left")


def newest_from_counters(
    rollup: DataFrame, options: SearchOptions, rows: int
) -> tuple[int, datetime | None]:
    """How many of the newest `rows` matching counters exist, and the earliest second
    among them.

    Counters are exact per (second, service, level) and each stands for at least
    one row. When all `rows` of them exist, at least that many matching rows lie at
    or after that second, so it bounds a newest-first scan from below without
    losing a row. Message and attribute filters are not counted.
    """
    if not options.counted_by_rollup:
        return 0, None
    # Only seconds that lie wholly before the end count.
    ends = [floor_second(m) for m in (options.until, options.cursor and options.cursor.timestamp) if m]
    since = ceil_second(options.since) if options.since else None
    newest = (
        where_all(
            rollup,
            equals(options.service, options.level)
            + time_range(rollup, "bucket_start", since, min(ends) if ends else None),
        )
        .select("bucket_start")
        .orderBy(F.desc("bucket_start"))
        .limit(rows)
    )
    found = newest.agg(
        F.count("*").alias("n"), F.unix_micros(F.min("bucket_start").cast("timestamp")).alias("micros")
    ).first()
    if found["n"] == 0:
        return 0, None
    return found["n"], datetime.fromtimestamp(found["micros"] // 1_000_000, timezone.utc)


def rendered_logs(rows: DataFrame) -> DataFrame:
    """Response shape: id as text, millisecond timestamp, attributes as JSON text."""
    return rows.select(
        F.col("id").cast("string").alias("id"),
        render_millis(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        "attributes",
    )
