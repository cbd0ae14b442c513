import json

import pytest
from helpers import batch, good, requests

from emberlog import summarise_requests, validate_requests

ISO = "Timestamp must be a valid ISO 8601 string"
MISSING = "Missing or invalid timestamp"
FUTURE = "Timestamp cannot be more than 5 minutes in the future"
SERVICE = "Service must be a non-empty string"
MESSAGE = "Message must be a non-empty string"
FLAT = "Attributes must be a flat object"


def bad(key):
    return f"Attribute '{key}' has invalid type 'object'"


CASES = [
    (good(), None),
    # entry
    ("5", "Entry must be an object"),
    ("null", "Entry must be an object"),
    ('"text"', "Entry must be an object"),
    ('"{\\"timestamp\\":\\"2026-07-20\\"}"', "Entry must be an object"),
    ("true", "Entry must be an object"),
    ("[1]", MISSING),
    ("[]", MISSING),
    ("{}", MISSING),
    # timestamp
    (good(timestamp=...), MISSING),
    (good(timestamp=""), MISSING),
    (good(timestamp=None), MISSING),
    (good(timestamp=1753009200), MISSING),
    (good(timestamp={"a": 1}), MISSING),
    (good(timestamp="today"), ISO),
    (good(timestamp="now"), ISO),
    (good(timestamp="12:30"), ISO),
    (good(timestamp=" 2026-07-20 "), ISO),
    (good(timestamp="2026-7-2"), ISO),
    (good(timestamp="2026-02-30T00:00:00Z"), ISO),
    (good(timestamp="2026-13-01T00:00:00Z"), ISO),
    (good(timestamp="2026-07-20T25:00:00Z"), ISO),
    (good(timestamp="2026-07-19T24:00:01Z"), ISO),
    (good(timestamp="2026-07-19T24:00:00Z"), None),
    (good(timestamp="2026-07-19T24:00+05:30"), None),
    (good(timestamp="2026-07"), None),
    (good(timestamp="2026-07-20"), None),
    (good(timestamp="2026-07-20T10:00"), None),
    (good(timestamp="2026-07-20T10:00Z"), None),
    (good(timestamp="2026-07-20T10:00+05:30"), None),
    (good(timestamp="2026-07-20T10:00:00"), None),
    (good(timestamp="2026-07-20T10:00:00.123456789Z"), None),
    (good(timestamp="2026-07-20T10:00:00.123456789012345678901Z"), None),
    (good(timestamp="1969-12-31T23:59:59.5Z"), None),
    (good(timestamp="2026-07-20T12:05:00Z"), None),
    (good(timestamp="2026-07-20T12:05:00.0009Z"), None),
    (good(timestamp="2026-07-20T12:05:00.001Z"), FUTURE),
    (good(timestamp="2026-07-20T17:35:00+05:30"), None),
    (good(timestamp="2026-07-20T17:35:00.001+05:30"), FUTURE),
    # level
    (good(level=...), "Invalid level: 'undefined'"),
    (good(level=None), "Invalid level: 'null'"),
    (good(level=5), "Invalid level: '5'"),
    (good(level=5.0), "Invalid level: '5'"),
    (good(level=False), "Invalid level: 'false'"),
    (good(level=""), "Invalid level: ''"),
    (good(level="ERROR"), "Invalid level: 'ERROR'"),
    (good(level={"a": 1}), "Invalid level: '[object Object]'"),
    (good(level=["error"]), "Invalid level: 'error'"),
    (good(level=[1, None, "x", {"a": 1}]), "Invalid level: '1,,x,[object Object]'"),
    # service and message
    (good(service=...), SERVICE),
    (good(service=""), SERVICE),
    (good(service=7), SERVICE),
    (good(service=" "), None),
    (good(message=...), MESSAGE),
    (good(message=""), MESSAGE),
    (good(message=["a"]), MESSAGE),
    (good(message="   "), None),
    # attributes
    (good(attributes=...), None),
    (good(attributes=None), None),
    (good(attributes={}), None),
    (good(attributes=[]), FLAT),
    (good(attributes=[1]), FLAT),
    (good(attributes="x"), FLAT),
    (good(attributes=3), FLAT),
    (good(attributes={"a": 1, "b": None}), bad("b")),
    (good(attributes={"b": [1], "a": {}}), bad("b")),
    (good(attributes={"a": {}, "b": [1]}), bad("a")),
    (good(attributes={"z": {}, "10": None, "9": []}), bad("9")),
    (good(attributes={"z": {}, "01": None}), bad("z")),
    (good(attributes={"a: VOID": 1, "b": "OBJECT<"}), None),
    ('{"timestamp":"2026-07-20","level":"info","service":"s","message":"m",'
     '"attributes":{"a":{},"b":{},"a":1}}', bad("b")),
    ('{"timestamp":"2026-07-20","level":"bad","level":"info","service":"s","message":"m"}', None),
    # the first failing rule wins
    (good(level="bad", service="", message=""), "Invalid level: 'bad'"),
    (good(service="", message=""), SERVICE),
    (good(message="", attributes=[1]), MESSAGE),
    # what fixed columns cannot hold
    (good(service="s" * 100), None),
    (good(service="s" * 101), "Service exceeds 100 characters"),
    (good(message="a\0b"), "Text contains a null character"),
    (good(attributes={"k": "a\0b"}), "Text contains a null character"),
    (good(attributes={"k": "a\\u0000b"}), None),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = validate_requests(requests(spark, batch(*[entry for entry, _ in CASES]))).collect()
    return {row["index"]: row for row in rows}


@pytest.mark.parametrize("n", range(len(CASES)), ids=lambda n: str(CASES[n][0])[:60])
def test_reason(judged, n):
    assert judged[n]["reason"] == CASES[n][1]


def accepted(spark, *entries):
    rows = validate_requests(requests(spark, batch(*entries))).selectExpr(
        "index", "reason", "string(timestamp) AS ts", "attributes", "attr_text"
    )
    return [row for row in sorted(rows.collect(), key=lambda r: r["index"])]


def test_instants(spark):
    texts = {
        "2026-07": "2026-07-01 00:00:00",
        "2026-07-20": "2026-07-20 00:00:00",
        "2026-07-20T10:00": "2026-07-20 10:00:00",
        "2026-07-20T10:00+05:30": "2026-07-20 04:30:00",
        "2026-07-20T10:00:00.123456789Z": "2026-07-20 10:00:00.123456",
        "2026-07-20T10:00:00.123456789012345678901-01:00": "2026-07-20 11:00:00.123456",
        "2026-07-19T24:00:00.000Z": "2026-07-20 00:00:00",
        "2026-07-19T24:00+05:30": "2026-07-19 18:30:00",
    }
    rows = accepted(spark, *[good(timestamp=t) for t in texts])
    assert [r["ts"] for r in rows] == list(texts.values())
    from emberlog.functions.timestamps import parse_instant

    assert [parse_instant(t).replace(tzinfo=None).isoformat(sep=" ") for t in texts] == list(texts.values())


def test_attribute_numbers_are_plain_text(spark):
    numbers = {
        "3.0": "3", "1e21": "1" + "0" * 21, "1.5e-7": "0.00000015", "0.0005": "0.0005", "1E2": "100",
        "-0.0": "0", "1.50": "1.5", "0.0000001": "0.0000001", "9007199254740993": "9007199254740993",
        "-12345678.912": "-12345678.912", "1.25e10": "12500000000",
    }
    entries = [
        '{"timestamp":"2026-07-20","level":"info","service":"s","message":"m","attributes":{"k\\"q":%s}}' % n
        for n in numbers
    ]
    rows = accepted(spark, *entries)
    assert [r["attr_text"] for r in rows] == [{'k"q': text} for text in numbers.values()]
    assert [r["attributes"] for r in rows] == ['{"k\\"q":%s}' % text for text in numbers.values()]


def test_attribute_values_keep_their_type(spark):
    (row,) = accepted(spark, good(attributes={"s": "3", "n": 3, "b": True, "dotted.key": "é\n"}))
    assert json.loads(row["attributes"]) == {"s": "3", "n": 3, "b": True, "dotted.key": "é\n"}
    assert row["attr_text"] == {"s": "3", "n": "3", "b": "true", "dotted.key": "é\n"}


def test_absent_attributes_are_an_empty_object(spark):
    rows = accepted(spark, good(attributes=...), good(attributes=None), good(attributes={}))
    assert [(r["attributes"], r["attr_text"]) for r in rows] == [("{}", {})] * 3


def test_responses(spark):
    shape = 'Request body must be an object with a "logs" array'
    malformed = "Request body is not valid JSON"
    bodies = {
        batch(good(), good(level="not-a-real-level")): (200, 1, [(1, "Invalid level: 'not-a-real-level'")], None),
        '{ "logs": [ not valid': (400, 0, [], malformed),
        batch(good()) + " x": (400, 0, [], malformed),
        batch(good()) + batch(good()): (400, 0, [], malformed),
        "  " + batch(good()) + "\n": (200, 1, [], None),
        "": (400, 0, [], malformed),
        '{"logs":[]}': (400, 0, [], "Logs array cannot be empty"),
        '{"logs":{"a":1}}': (400, 0, [], shape),
        '{"logs":null}': (400, 0, [], shape),
        "{}": (400, 0, [], shape),
        "[1]": (400, 0, [], shape),
        "null": (400, 0, [], shape),
        "7": (400, 0, [], shape),
        batch("5"): (400, 0, [(0, "Entry must be an object")], None),
        '{"logs":[],' + batch(good())[1:]: (200, 1, [], None),
    }
    summary = summarise_requests(validate_requests(requests(spark, *bodies))).collect()
    found = {
        int(r["request_id"]): (r["status"], r["accepted"], [tuple(x) for x in r["rejected"]], r["error"])
        for r in summary
    }
    assert [found[n] for n in range(len(bodies))] == list(bodies.values())


def test_requests_sharing_an_id_answer_separately(spark):
    twice = requests(spark, batch(good()), batch("5")).selectExpr("'same' AS request_id", "body", "received_at")
    summary = summarise_requests(validate_requests(twice)).collect()
    assert sorted(r["accepted"] for r in summary) == [0, 1]


def test_validation_does_not_shuffle(spark):
    plan = validate_requests(requests(spark, batch(good())))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
