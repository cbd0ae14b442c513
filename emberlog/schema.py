"""Column layouts and fixed values of the log model."""

from __future__ import annotations

from datetime import timedelta

# The closed set of levels and the supported bucket sizes.
LEVELS = ("debug", "info", "warn", "error")
BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
FUTURE_TOLERANCE = timedelta(minutes=5)
MAX_SERVICE_LENGTH = 100
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
DEFAULT_RETENTION_DAYS = 30

REQUEST_SCHEMA = "request_id STRING, body STRING, received_at TIMESTAMP"

LOG_COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")

PARTITION_COLUMNS = ("day", "batch_id")

TABLE_SCHEMAS = {
    # attributes is the canonical JSON text a reader gets back; attr_text holds
    # the same pairs with every value as text, so an attribute filter never
    # parses JSON.
    "logs": (
        "id BIGINT, timestamp TIMESTAMP, level STRING, service STRING, message STRING, "
        "attributes STRING, attr_text MAP<STRING, STRING>, day DATE, batch_id BIGINT"
    ),
    "log_rollup_1s": (
        "bucket_start TIMESTAMP, service STRING, level STRING, count BIGINT, "
        "day DATE, batch_id BIGINT"
    ),
    "responses": (
        "request_id STRING, received_at TIMESTAMP, status INT, accepted INT, "
        "rejected ARRAY<STRUCT<index: INT, reason: STRING>>, error STRING, "
        "day DATE, batch_id BIGINT"
    ),
}

#: Counters of whole minutes and hours, built by maintenance over those of seconds: seconds in a bucket.
COARSE_TABLES = {"log_rollup_1m": 60, "log_rollup_1h": 3600}
TABLE_SCHEMAS_COARSE = dict.fromkeys(COARSE_TABLES, TABLE_SCHEMAS["log_rollup_1s"])
BUCKET_SECONDS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}

#: Filters over the messages and attributes of each file of `logs`, built by maintenance under the
#: day and batch of the file.
FILTER_SCHEMA = "file STRING, kind STRING, slices BIGINT, slice BIGINT, bits BINARY, day DATE, batch_id BIGINT"

#: One row per attempt to append a batch: outcome is committed, replayed (taken before) or failed.
METRICS_SCHEMA = (
    "source STRING, version BIGINT, batch_id BIGINT, outcome STRING, accepted BIGINT, rejected BIGINT, "
    "started TIMESTAMP, seconds DOUBLE, error STRING, day DATE"
)
