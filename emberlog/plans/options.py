"""Flat request parameters to checked, typed options."""

from __future__ import annotations

import base64
import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from emberlog.functions.timestamps import last_before, parse_instant
from emberlog.plans.errors import InvalidQueryError
from emberlog.schema import BUCKETS, DEFAULT_LIMIT, LEVELS, MAX_LIMIT

# The texts of the errors in this module, which clients match on.

ATTRIBUTE_PREFIX = "attr."
GROUPINGS = ("service", "level")
_ATTRIBUTE_KEY = re.compile(r"[a-zA-Z0-9_.-]+")
_BIGINT_MAX = 2**63 - 1


@dataclass(frozen=True)
class AttrFilter:
    key: str
    value: str

    def __post_init__(self) -> None:
        if not is_attribute_key(self.key):
            raise InvalidQueryError(f"Invalid attribute key format: '{self.key}'")


@dataclass(frozen=True)
class Cursor:
    """Position of the last row already returned."""

    timestamp: datetime
    id: int

    def encode(self) -> str:
        stamp = self.timestamp.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ").zfill(27)
        return base64.b64encode(f"{stamp}|{self.id}".encode()).decode()


@dataclass(frozen=True)
class SearchOptions:
    service: str | None = None
    level: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    q: str | None = None
    attrs: tuple[AttrFilter, ...] = ()
    cursor: Cursor | None = None
    limit: int | None = DEFAULT_LIMIT
    literal_q: bool = False

    @property
    def last_instant(self) -> datetime | None:
        """Latest instant a match can have."""
        ends = [last_before(self.until)] if self.until else []
        ends += [self.cursor.timestamp] if self.cursor else []
        return min(ends, default=None)

    @property
    def counted_by_rollup(self) -> bool:
        """Counters hold neither message nor attributes."""
        return not self.attrs and not self.q


@dataclass(frozen=True)
class AggregateOptions:
    since: datetime
    until: datetime
    bucket: str
    service: str | None = None
    level: str | None = None
    q: str | None = None
    attrs: tuple[AttrFilter, ...] = ()
    group_by: str | None = None
    literal_q: bool = False

    def __post_init__(self) -> None:
        if self.bucket not in BUCKETS:
            raise InvalidQueryError(f"Invalid bucket size. Supported: {', '.join(BUCKETS)}")
        if self.group_by is not None and self.group_by not in GROUPINGS:
            raise InvalidQueryError('group_by must be either "service" or "level"')

    @property
    def counted_by_rollup(self) -> bool:
        """Counters hold neither message nor attributes."""
        return not self.attrs and not self.q


def is_attribute_key(key: str) -> bool:
    return _ATTRIBUTE_KEY.fullmatch(key) is not None


def _limit(params: Mapping[str, str]) -> int:
    if "limit" not in params:
        return DEFAULT_LIMIT
    # Leading integer only: '10abc' is 10 and '1.9' is 1.
    leading = re.match(r"\s*([+-]?\d+)", params["limit"], re.ASCII)
    value = int(leading.group(1)) if leading else 0
    if not 1 <= value <= MAX_LIMIT:
        raise InvalidQueryError(f"Limit must be a number between 1 and {MAX_LIMIT}")
    return value


def _level(params: Mapping[str, str]) -> str | None:
    level = params.get("level")
    if level is not None and level not in LEVELS:
        raise InvalidQueryError(f"Invalid level: '{level}'")
    return level


def _instant(params: Mapping[str, str], name: str) -> datetime | None:
    if name not in params:
        return None
    moment = parse_instant(params[name])
    if moment is None:
        raise InvalidQueryError(f"Invalid {name} timestamp")
    return moment


def _check_order(since: datetime | None, until: datetime | None) -> None:
    if since is not None and until is not None and until < since:
        raise InvalidQueryError("until must not be earlier than since")


def _attributes(params: Mapping[str, str]) -> tuple[AttrFilter, ...]:
    return tuple(
        AttrFilter(name[len(ATTRIBUTE_PREFIX):], value)
        for name, value in params.items()
        if name.startswith(ATTRIBUTE_PREFIX)
    )


def decode_cursor(text: str) -> Cursor:
    # Either base64 alphabet, padding optional, anything else skipped.
    letters = re.sub(r"[^A-Za-z0-9+/]", "", text.split("=")[0].translate(str.maketrans("-_", "+/")))
    letters = letters[: len(letters) - 1] if len(letters) % 4 == 1 else letters
    decoded = base64.b64decode(letters + "=" * (-len(letters) % 4)).decode("utf-8", "replace")
    stamp, separator, row = decoded.rpartition("|")
    moment = parse_instant(stamp) if separator else None
    number = int(row) if re.fullmatch(r"[+-]?\d{1,19}", row, re.ASCII) else None
    if moment is None or number is None or abs(number) > _BIGINT_MAX:
        raise InvalidQueryError("Invalid cursor format")
    return Cursor(moment, number)


def parse_search_params(params: Mapping[str, str]) -> SearchOptions:
    """Checks run in the order the search contract reports them; an empty string
    counts as absent for service, q and cursor."""
    limit = _limit(params)
    level = _level(params)
    since, until = _instant(params, "since"), _instant(params, "until")
    _check_order(since, until)
    attrs = _attributes(params)
    cursor = decode_cursor(params["cursor"]) if params.get("cursor") else None
    return SearchOptions(
        service=params.get("service") or None,
        level=level,
        since=since,
        until=until,
        q=params.get("q") or None,
        attrs=attrs,
        cursor=cursor,
        limit=limit,
    )


def parse_aggregate_params(params: Mapping[str, str]) -> AggregateOptions:
    if not (params.get("since") and params.get("until") and params.get("bucket")):
        raise InvalidQueryError("Missing required parameters: since, until, bucket")
    since, until = _instant(params, "since"), _instant(params, "until")
    _check_order(since, until)
    level = _level(params)
    if params["bucket"] not in BUCKETS:
        raise InvalidQueryError(f"Invalid bucket size. Supported: {', '.join(BUCKETS)}")
    attrs = _attributes(params)
    return AggregateOptions(
        since=since,
        until=until,
        bucket=params["bucket"],
        service=params.get("service") or None,
        level=level,
        q=params.get("q") or None,
        attrs=attrs,
        group_by=params.get("group_by") or None,
    )
