"""Small hand-written inputs."""

import json
from datetime import datetime, timedelta, timezone

RECEIVED = "2026-07-20T12:00:00Z"
LOG_DDL = (
    "id BIGINT, timestamp TIMESTAMP_NTZ, level STRING, service STRING, message STRING, attributes STRING"
)


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def good(**changes):
    entry = {
        "timestamp": "2026-05-09T18:05:07.25Z",
        "level": "warn",
        "service": "mailer",
        "message": "queue is full",
        "attributes": {"tenant": "t-9", "zone": "b-7", "depth": 5000},
    }
    entry.update(changes)
    return {k: v for k, v in entry.items() if v is not ...}


def requests(spark, *bodies, received=RECEIVED):
    rows = [(str(n), b if b is None or isinstance(b, str) else json.dumps(b)) for n, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "request_id STRING, body STRING")
    return frame.selectExpr("*", f"timestamp'{received}' AS received_at")


def batch(*entries):
    """Request body; an entry given as a string is JSON text already."""
    return '{"logs":[' + ",".join(e if isinstance(e, str) else json.dumps(e) for e in entries) + "]}"


def logs(spark, rows):
    """Rows of (id, naive timestamp, level, service, message, attributes)."""
    return spark.createDataFrame(rows, LOG_DDL)


def random_logs(spark, rng, count, days=3):
    start = datetime(2024, 1, 1)
    rows = [
        (
            n,
            start + timedelta(microseconds=rng.randrange(days * 86_400 * 10) * 100_000),
            rng.choice(["debug", "info", "warn", "error"]),
            rng.choice(["a", "b", "c"]),
            f"message {n % 7}",
            json.dumps({"k": n % 5}),
        )
        for n in range(count)
    ]
    return rows, logs(spark, rows)
