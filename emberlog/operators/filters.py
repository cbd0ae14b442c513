"""Predicates over a `logs` frame, written so that they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import variants as V
from emberlog.functions.text import contains_pattern
from emberlog.functions.timestamps import instant_literal, last_before, utc_date
from emberlog.plans.options import AttrFilter, Cursor


def _day(moment: datetime) -> Column:
    """Its UTC day; from text, as a date of year 1 does not pass to the JVM otherwise."""
    return F.lit(utc_date(moment).isoformat()).cast("date")


def time_range(
    frame: DataFrame, column: str, since: datetime | None, until: datetime | None
) -> list[Column]:
    """since <= column < until, with the matching bounds on `day` when it exists.

    Spark does not derive day from timestamp, so the partition bound is explicit.
    """
    like = frame.schema[column].dataType
    by_day = "day" in frame.columns
    conditions = []
    if since is not None:
        conditions.append(F.col(column) >= instant_literal(since, like))
        if by_day:
            conditions.append(F.col("day") >= _day(since))
    if until is not None:
        conditions.append(F.col(column) < instant_literal(until, like))
        if by_day:
            conditions.append(F.col("day") <= _day(last_before(until)))
    return conditions


def equals(service: str | None, level: str | None) -> list[Column]:
    wanted = {"service": service, "level": level}
    return [F.col(name) == value for name, value in wanted.items() if value]


def message_contains(q: str | None, literal: bool = False) -> list[Column]:
    return [F.col("message").ilike(contains_pattern(q, literal))] if q else []


def attribute_equals(frame: DataFrame, attrs: Iterable[AttrFilter]) -> list[Column]:
    """One literal top-level key compared as text; a missing key or null never matches."""
    if "attr_text" in frame.columns:
        return [F.col("attr_text")[F.lit(a.key)] == a.value for a in attrs]
    return [_may_hold(a.value) & _holds(a.key, a.value) for a in attrs]


def _holds(key: str, value: str) -> Column:
    """Compared as text; of a repeated key the last value counts, as in stored logs."""
    # The bracketed path names exactly one key, dots included; a key holds no quote.
    path = f"$['{key}']"
    parsed = f"""try_variant_get(try_parse_json(attributes), "{path}", 'variant')"""
    if not value.startswith(("{", "[")):
        # A number may be written in other digits than it compares by. The one-element
        # array names the parsed value, so that it is parsed once.
        return F.expr(f"get(transform(array({parsed}), v -> {V.scalar_text('v')}), 0)") == value
    return F.get_json_object("attributes", path) == value


def _may_hold(value: str) -> Column:
    """Spares most rows the JSON parse: a scalar stands in the text as it is, unless
    the text holds escapes or exponents. Nested values are written in many ways."""
    if value.startswith(("{", "[")):
        return F.lit(True)
    return F.col("attributes").contains(value) | F.col("attributes").rlike(r"\\|[0-9][eE][-+0-9]")


def before_cursor(frame: DataFrame, cursor: Cursor | None) -> list[Column]:
    """(timestamp, id) < cursor, spelled out so that its first half is pushed down."""
    if cursor is None:
        return []
    at = instant_literal(cursor.timestamp, frame.schema["timestamp"].dataType)
    conditions = [
        F.col("timestamp") <= at,
        (F.col("timestamp") < at) | (F.col("id") < F.lit(cursor.id)),
    ]
    if "day" in frame.columns:
        conditions.append(F.col("day") <= _day(cursor.timestamp))
    return conditions


def where_all(frame: DataFrame, conditions: list[Column]) -> DataFrame:
    return frame.where(reduce(and_, conditions)) if conditions else frame
