import base64

import pytest
from helpers import utc

from emberlog import Cursor, InvalidQueryError, parse_aggregate_params, parse_search_params, search_logs
from emberlog.functions.timestamps import ceil_second, floor_second, parse_instant
from emberlog.plans.options import AttrFilter, decode_cursor


def failing(parse, **params):
    with pytest.raises(InvalidQueryError) as caught:
        parse({k.replace("__", "."): v for k, v in params.items()})
    return str(caught.value)


LIMIT = "Limit must be a number between 1 and 1000"
ORDER = "until must not be earlier than since"
REQUIRED = "Missing required parameters: since, until, bucket"
BUCKET = "Invalid bucket size. Supported: 1m, 5m, 1h, 1d"


@pytest.mark.parametrize("text,limit", [("1", 1), ("1000", 1000), ("10abc", 10), ("1.9", 1), (" 7", 7), ("+5", 5)])
def test_limit_takes_the_leading_integer(text, limit):
    assert parse_search_params({"limit": text}).limit == limit


@pytest.mark.parametrize("text", ["", "0", "1001", "-1", "abc", "1e3x"[:0]])
def test_limit_out_of_range(text):
    assert failing(parse_search_params, limit=text) == LIMIT


def test_search_defaults_and_empty_strings():
    assert parse_search_params({}).limit == 100
    options = parse_search_params({"service": "", "q": "", "cursor": ""})
    assert (options.service, options.q, options.cursor) == (None, None, None)


def test_search_errors():
    assert failing(parse_search_params, level="") == "Invalid level: ''"
    assert failing(parse_search_params, level="bogus") == "Invalid level: 'bogus'"
    assert failing(parse_search_params, since="") == "Invalid since timestamp"
    assert failing(parse_search_params, until="tomorrow") == "Invalid until timestamp"
    assert failing(parse_search_params, since="2026-01-02", until="2026-01-01") == ORDER
    assert parse_search_params({"since": "2026-01-01", "until": "2026-01-01"}).since == utc(2026, 1, 1)
    # limit is reported before level, level before since
    assert failing(parse_search_params, limit="x", level="x", since="x") == LIMIT
    assert failing(parse_search_params, level="x", since="x") == "Invalid level: 'x'"


@pytest.mark.parametrize("key", ["k", "Trace_9", "net.peer-ip", "-", "_.", "007"])
def test_attribute_keys(key):
    assert parse_search_params({f"attr.{key}": "v"}).attrs == (AttrFilter(key, "v"),)


@pytest.mark.parametrize("key", ["", "it's", "a\tb", 'say"', "k]", "$.k", "x=y", "ключ", "end\n"])
def test_bad_attribute_keys(key):
    message = f"Invalid attribute key format: '{key}'"
    for parse, base in (
        (parse_search_params, {}),
        (parse_aggregate_params, {"since": "2026-01-01", "until": "2026-01-02", "bucket": "1h"}),
    ):
        with pytest.raises(InvalidQueryError) as caught:
            parse({**base, f"attr.{key}": "v"})
        assert str(caught.value) == message
    with pytest.raises(InvalidQueryError):
        AttrFilter(key, "v")


def test_the_earliest_bound_there_is(spark):
    options = parse_search_params({"until": "0001-01-01"})
    assert options.last_instant == utc(1, 1, 1)
    frame = spark.sql(
        "SELECT 1L AS id, timestamp_ntz'0001-01-01 00:00:00' AS timestamp, date'0001-01-01' AS day, "
        "'info' AS level, 'a' AS service, 'm' AS message, '{}' AS attributes"
    )
    assert search_logs(frame, options).count() == 0


def test_cursor_round_trip():
    for cursor in (Cursor(utc(2024, 1, 16, 1, 3, 34, 557814), 5000), Cursor(utc(999, 1, 1), -1)):
        assert decode_cursor(cursor.encode()) == cursor
    text = base64.b64encode(b"2026-08-01T20:01:45.884Z|109795").decode()
    for form in (text, text.rstrip("="), text.replace("+", "-").replace("/", "_")):
        assert decode_cursor(form) == Cursor(utc(2026, 8, 1, 20, 1, 45, 884000), 109795)


@pytest.mark.parametrize(
    "raw", [b"nothing", b"2026-01-01|", b"2026-01-01|1e3", b"yesterday|5", b"|5", b"2026-01-01|99999999999999999999", b"\xff\xfe"]
)
def test_bad_cursors(raw):
    assert failing(parse_search_params, cursor=base64.b64encode(raw).decode()) == "Invalid cursor format"


def test_cursor_that_is_not_base64():
    assert failing(parse_search_params, cursor="!!!") == "Invalid cursor format"
    assert failing(parse_search_params, cursor="abcde") == "Invalid cursor format"


def test_aggregate_errors_in_order():
    base = {"since": "2026-01-01", "until": "2026-01-02", "bucket": "1h"}
    for name in base:
        assert failing(parse_aggregate_params, **{**base, name: ""}) == REQUIRED
        assert failing(parse_aggregate_params, **{k: v for k, v in base.items() if k != name}) == REQUIRED
    assert failing(parse_aggregate_params, **{**base, "since": "x", "until": "y"}) == "Invalid since timestamp"
    assert failing(parse_aggregate_params, **{**base, "until": "y", "level": "x"}) == "Invalid until timestamp"
    assert failing(parse_aggregate_params, **{**base, "until": "2025-01-01", "level": "x"}) == ORDER
    assert failing(parse_aggregate_params, **base, level="x") == "Invalid level: 'x'"
    assert failing(parse_aggregate_params, **{**base, "bucket": "2h", "level": "x"}) == "Invalid level: 'x'"
    for bucket in ("2h", "constructor", "toString"):
        assert failing(parse_aggregate_params, **{**base, "bucket": bucket, "group_by": "x"}) == BUCKET
    assert (
        failing(parse_aggregate_params, **base, group_by="message")
        == 'group_by must be either "service" or "level"'
    )
    assert parse_aggregate_params({**base, "group_by": ""}).group_by is None


def test_instants_on_the_driver():
    assert parse_instant("2026-07-20T10:00:00.1234567+05:30") == utc(2026, 7, 20, 4, 30, 0, 123456)
    for text in ("2026", "today", "2026-02-30", "2026-07-20T10:00:00+19:00", "2026-07-20T10", "0000-01-01", "2026-07-20\n"):
        assert parse_instant(text) is None
    assert ceil_second(utc(2026, 1, 1, 0, 0, 0, 1)) == utc(2026, 1, 1, 0, 0, 1)
    assert ceil_second(utc(2026, 1, 1)) == floor_second(utc(2026, 1, 1, 0, 0, 0, 999999)) == utc(2026, 1, 1)
