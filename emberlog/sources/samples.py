"""Log-shaped inputs derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.timestamps import render_micros
from emberlog.session import configure

EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
RECEIVED_AT = "2024-02-01T00:00:00Z"
ENTRIES_PER_REQUEST = 40


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "view", "debug")
    ).otherwise("info")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("service"),
        F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.col("props").alias("attributes"),
    )


def _entry(logs: DataFrame) -> Column:
    return F.to_json(
        F.struct(
            render_micros(F.col("timestamp")).alias("timestamp"),
            "level",
            "service",
            "message",
            F.parse_json("attributes").alias("attributes"),
        )
    )


def _with_defect(kind: Column) -> Column:
    """Entry text with the defect its remainder by 12 stands for; 0 to 2 are valid."""
    logs_entry = {
        "timestamp": render_micros(F.col("timestamp")),
        "level": F.col("level"),
        "service": F.col("service"),
        "message": F.col("message"),
        "attributes": F.parse_json("attributes"),
    }

    def entry(**changes: Column | None) -> Column:
        fields = {**logs_entry, **changes}
        return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items() if c is not None]))

    return (
        F.when(kind == 3, F.lit("5"))
        .when(kind == 4, entry(timestamp=None))
        .when(kind == 5, entry(timestamp=F.lit("today")))
        .when(kind == 6, entry(timestamp=F.lit("2024-02-01T00:05:00.001Z")))
        .when(kind == 7, entry(level=F.lit("critical")))
        .when(kind == 8, entry(service=F.lit("")))
        .when(kind == 9, entry(message=F.lit(7)))
        .when(kind == 10, entry(attributes=F.array(F.lit(1))))
        .when(
            kind == 11,
            F.concat(
                F.regexp_replace(entry(attributes=None), r"\}$", ""),
                F.lit(',"attributes":{"z":{"a":1},"b":1}}'),
            ),
        )
        .otherwise(entry())
    )


def request_bodies(spark: SparkSession, sf_dir: str, defects: bool = False) -> DataFrame:
    """Requests of up to 40 consecutive entries: (request_id, body, received_at)."""
    logs = logs_from_events(spark, sf_dir)
    text = _with_defect(F.col("id") % 12) if defects else _entry(logs)
    request = F.expr(f"id div {ENTRIES_PER_REQUEST}")
    entries = logs.select(request.alias("request_id"), "id", text.alias("entry"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "entry"))), lambda e: e["entry"])
    body = F.concat(F.lit('{"logs":['), F.array_join(ordered, ","), F.lit("]}"))
    return entries.groupBy("request_id").agg(body.alias("body")).select(
        F.col("request_id").cast("string").alias("request_id"),
        "body",
        F.lit(RECEIVED_AT).cast("timestamp").alias("received_at"),
    )
