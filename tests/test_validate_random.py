"""Random entries against the rules written out once more in plain Python."""

import json
import random
import re

from helpers import RECEIVED, batch, requests

from emberlog import summarise_requests, validate_requests
from emberlog.functions.timestamps import instant_sql, parse_instant

MISSING = object()
TIMES = [
    "2026-07-20T11:00:00Z", "2026-07-20T12:05:00.000Z", "2026-07-20T12:05:00.001Z", "2026-07-21", "2026-07-20",
    "nope", "", "2026-07-20 11:00:00", "2026-07-20T11:00:00+05:30", "2026-07-20T11:00", "2027-01", "2026-06-31",
]
SCALARS = ["", "x", 0, 1, -3, 2.5, True, False, None, "null", "5"]
KEYS = ["a", "b", "10", "9", "007", "k.k", "a b", "é", 'q"q', "attributes"]


def scalar(rng):
    return rng.choice(SCALARS)


def value(rng):
    return rng.choice([scalar(rng), scalar(rng), [], [1, "a"], {}, {"x": 1}])


def entry(rng):
    if rng.random() < 0.1:
        return value(rng)
    made = {
        "timestamp": rng.choice(TIMES) if rng.random() < 0.9 else value(rng),
        "level": rng.choice(["debug", "info", "warn", "error"]) if rng.random() < 0.85 else value(rng),
        "service": "svc" if rng.random() < 0.85 else value(rng),
        "message": "msg" if rng.random() < 0.85 else value(rng),
        "attributes": {k: value(rng) if rng.random() < 0.3 else "v" for k in rng.sample(KEYS, rng.randrange(5))}
        if rng.random() < 0.85
        else value(rng),
    }
    for name in list(made):
        if rng.random() < 0.04:
            del made[name]
    rng.shuffle(items := list(made.items()))
    return dict(items)


def written(v):
    if v is MISSING:
        return "undefined"
    if isinstance(v, list):
        return ",".join("" if x is None else written(x) for x in v)
    if isinstance(v, dict):
        return "[object Object]"
    return {None: "null", True: "true", False: "false"}.get(v) if v is None or isinstance(v, bool) else str(v)


def reason(e):
    if not isinstance(e, (dict, list)):
        return "Entry must be an object"
    read = (lambda k: e.get(k, MISSING)) if isinstance(e, dict) else (lambda k: MISSING)
    stamp = read("timestamp")
    if not isinstance(stamp, str) or not stamp:
        return "Missing or invalid timestamp"
    at = parse_instant(stamp)
    if at is None:
        return "Timestamp must be a valid ISO 8601 string"
    if (at - parse_instant(RECEIVED)).total_seconds() > 300:
        return "Timestamp cannot be more than 5 minutes in the future"
    if read("level") not in ("debug", "info", "warn", "error"):
        return f"Invalid level: '{written(read('level'))}'"
    for name, label in (("service", "Service"), ("message", "Message")):
        if not isinstance(read(name), str) or not read(name):
            return f"{label} must be a non-empty string"
    attributes = read("attributes")
    if attributes is MISSING or attributes is None:
        return None
    if not isinstance(attributes, dict):
        return "Attributes must be a flat object"
    numbered = sorted((k for k in attributes if re.fullmatch("0|[1-9][0-9]*", k)), key=int)
    for key in numbered + [k for k in attributes if k not in numbered]:
        if attributes[key] is None or isinstance(attributes[key], (dict, list)):
            return f"Attribute '{key}' has invalid type 'object'"
    return None


def text(v):
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else str(v)


def test_random_entries(spark):
    rng = random.Random(11)
    bodies = [[entry(rng) for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    frame = requests(spark, *[batch(*[json.dumps(e, ensure_ascii=rng.random() < 0.5) for e in b]) for b in bodies])
    judged = validate_requests(frame)
    rows = {(int(r["request_id"]), r["index"]): r for r in judged.collect()}
    assert len(rows) == sum(map(len, bodies))
    verdicts = set()
    for n, body in enumerate(bodies):
        for i, e in enumerate(body):
            row, expected = rows[n, i], reason(e)
            verdicts.add((expected or "accepted").split("'")[0])
            assert row["reason"] == expected, e
            if expected is None:
                attributes = e.get("attributes") or {}
                assert json.loads(row["attributes"]) == attributes
                assert row["attr_text"] == {k: text(v) for k, v in attributes.items()}
                assert (row["level"], row["service"], row["message"]) == (e["level"], e["service"], e["message"])
    assert len(verdicts) == 10
    for r in summarise_requests(judged).collect():
        expected = [reason(e) for e in bodies[int(r["request_id"])]]
        rejected = [(i, why) for i, why in enumerate(expected) if why]
        assert [tuple(x) for x in r["rejected"]] == rejected
        assert r["accepted"] == len(expected) - len(rejected)
        assert r["status"] == (200 if r["accepted"] else 400)


def test_both_instant_parsers_agree(spark):
    rng = random.Random(11)
    days = ["0000-01-01", "0000-12-31", "0001-01-01", "9999-12-31", "1900-02-29", "2024-02-29", "0000-06", "9999-12", "10000-01-01", "1582-10-10"]
    times = ["", "T00:00", "T00:00:00", "T24:00", "T24:00:00.0", "T23:59:59.999999", "T23:59:59.9999999", "T23:59", "T12:00:60"]
    zones = ["", "Z", "+05:00", "-05:00", "+18:00", "-18:00", "+18:01", "+00:60"]
    texts = sorted({rng.choice(days) + rng.choice(times) + rng.choice(zones) for _ in range(600)})
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING").selectExpr("t", f"CAST({instant_sql('t')} AS STRING) AS at")
    for text, at in frame.collect():
        expected = parse_instant(text)
        found = at and (at if "." in at else at + ".0")
        if expected is None:
            assert at is None, text
        else:
            assert found and found.split(".")[0] == expected.strftime("%Y-%m-%d %H:%M:%S").rjust(19, "0"), (text, at, expected)
            assert int(found.split(".")[1].ljust(6, "0")) == expected.microsecond
