"""ISO-8601 instants, on the driver for parameters and as columns for data."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

# Fixed pattern: calendar date with optional day, time, fraction and offset.
ISO_8601 = (
    r"^\d{4}-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:\d{2})?)?)?$"
)
_ISO_PARTS = re.compile(
    r"(?P<y>\d{4})-(?P<mo>\d{2})(?:-(?P<d>\d{2})"
    r"(?:T(?P<h>\d{2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:\.(?P<f>\d+))?)?"
    r"(?P<tz>Z|[+-]\d{2}:\d{2})?)?)?",
    re.ASCII,
)
_END_OF_DAY = r"T24:00(:00([.]0+)?)?(Z|[+-]\d{2}:\d{2})?$"

# The instants a Python datetime holds, for both parsers: UTC years 1 to 9999.
_FIRST, _LAST = "0001-01-01T00:00:00Z", "9999-12-31T23:59:59.999999Z"
MICROSECOND = timedelta(microseconds=1)

RENDER_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
RENDER_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def parse_instant(text: str) -> datetime | None:
    """UTC datetime for an ISO-8601 string, exact to the microsecond; None if it is not one."""
    match = _ISO_PARTS.fullmatch(text)
    if match is None:
        return None
    part = match.groupdict()
    hour, minute, second = int(part["h"] or 0), int(part["mi"] or 0), int(part["s"] or 0)
    micros = int((part["f"] or "0")[:6].ljust(6, "0"))
    next_day = hour == 24 and minute == second == 0 and not int(part["f"] or 0)
    # The calendar repeats every 400 years. Away from the ends of what a datetime holds, an
    # offset cannot leave it; whether the UTC year is 1 to 9999 shows on the way back.
    away = 400 if int(part["y"]) < 5000 else -400
    try:
        moment = datetime(
            int(part["y"]) + away, int(part["mo"]), int(part["d"] or 1),
            0 if next_day else hour, minute, second, micros, timezone.utc,
        )
        moment += timedelta(days=int(next_day))
        zone = part["tz"]
        if zone and zone != "Z":
            offset_hours, offset_minutes = int(zone[1:3]), int(zone[4:6])
            if offset_hours > 18 or offset_minutes > 59 or offset_hours * 60 + offset_minutes > 1080:
                return None
            offset = timedelta(hours=offset_hours, minutes=offset_minutes)
            moment += -offset if zone[0] == "+" else offset
        return moment.replace(year=moment.year - away)
    except ValueError:
        return None


def instant_sql(text: str) -> str:
    """TIMESTAMP for an ISO-8601 string expression, NULL for anything else and for instants
    whose UTC year is not 1 to 9999.

    A bare cast would also take 'today', '12:30' or padded text, and would refuse
    24:00, a long fraction, and a time without seconds that carries an offset.
    """
    within = f"t -> CASE WHEN t BETWEEN timestamp'{_FIRST}' AND timestamp'{_LAST}' THEN t END"
    parsed = f"""CASE
        WHEN NOT {text} RLIKE r'{ISO_8601}' THEN NULL
        WHEN substr({text}, 12, 2) = '24' THEN CASE WHEN {text} RLIKE r'{_END_OF_DAY}' THEN
            try_cast(concat(substr({text}, 1, 10), 'T00:00:00',
                regexp_extract({text}, r'(Z|[+-]\\d\\d:\\d\\d)$', 1)) AS TIMESTAMP) + INTERVAL 1 DAY END
        WHEN length({text}) > 32
            THEN try_cast(regexp_replace({text}, r'([.]\\d{{6}})\\d+', r'$1') AS TIMESTAMP)
        WHEN length({text}) > 10 AND substr({text}, 17, 1) <> ':'
            THEN try_cast(concat(substr({text}, 1, 16), ':00', substr({text}, 17)) AS TIMESTAMP)
        ELSE try_cast({text} AS TIMESTAMP) END"""
    # The one-element array names the parsed value, so that it is parsed once.
    return f"get(transform(array({parsed}), {within}), 0)"


def instant_literal(moment: datetime, like: DataType) -> Column:
    """A constant of the same timestamp type as the column it is compared with."""
    text = moment.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(like, TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "Z").cast("timestamp")


def last_before(moment: datetime) -> datetime:
    """The last microsecond before a moment; the first instant there is stays."""
    first = datetime.min.replace(tzinfo=timezone.utc)
    return max(moment, first + MICROSECOND) - MICROSECOND


def floor_second(moment: datetime) -> datetime:
    return moment.replace(microsecond=0)


def ceil_second(moment: datetime) -> datetime:
    floored = floor_second(moment)
    return floored if floored == moment else floored + timedelta(seconds=1)


def utc_date(moment: datetime) -> date:
    return moment.astimezone(timezone.utc).date()


def second_of(ts: Column, like: DataType) -> Column:
    """Whole UTC second, in the type of its input (date_trunc itself widens NTZ)."""
    return F.date_trunc("second", ts).cast(like)


def render_micros(ts: Column) -> Column:
    return F.date_format(ts, RENDER_MICROS)


def render_millis(ts: Column) -> Column:
    return F.date_format(ts, RENDER_MILLIS)
