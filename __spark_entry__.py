"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import replace
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import (
    LogStore,
    aggregate_logs,
    parse_aggregate_params,
    parse_search_params,
    scratch_dir,
    search_logs,
    summarise_requests,
    validate_requests,
)
from emberlog.operators.aggregate import aggregate_raw, rendered_buckets
from emberlog.operators.maintenance import build_coarse, build_filters, compact, drop_expired, partition_name_column, rebuild_counters, run_maintenance
from emberlog.operators.metrics import ingest_report
from emberlog.operators.rollup import merge_deltas, rollup_1s
from emberlog.operators.search import cursor_column, page_starts, paged_logs, rendered_logs
from emberlog.plans.options import Cursor
from emberlog.schema import LOG_COLUMNS
from emberlog.sources.requests import read_requests, stream_requests
from emberlog.sources.samples import logs_from_events, read_events, request_bodies
from emberlog.streaming.ingest import start_ingest

try:
    import corpus_pipeline
    from emberlog.llm import queries as llm
except ImportError:  # the subpackage or one of the libraries it needs is not there
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]
LOG_FIELDS = ("timestamp", "level", "service", "message", "attributes")
RANGE = {"since": "2024-01-03T04:05:06.7Z", "until": "2024-01-27T08:09:10.3Z"}
RETENTION_NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
COARSE_BEFORE = date(2024, 1, 20)


# -- inputs -----------------------------------------------------------------


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-hour timestamps, so that many rows share one."""
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    return logs_from_events(spark, sf_dir).withColumn("timestamp", hour)


def _dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes with dotted and dashed keys, a boolean, and a nested decoy."""
    user = F.substring_index("message", " ", -1)
    return logs_from_events(spark, sf_dir).withColumn(
        "attributes",
        F.concat(
            F.lit('{"user":{"id":"42"},"user.id":'), user,
            F.lit(',"user-id":"u'), user,
            F.lit('","even":'), (user.cast("bigint") % 2 == 0).cast("string"), F.lit("}"),
        ),
    )


def _new_store(spark: SparkSession, sf_dir: str, defects: bool = False, batches: int = 1) -> LogStore:
    """A store holding every event, its requests dealt out over the batches."""
    base = scratch_dir(spark, "store")
    store = LogStore(spark, f"{base}/store")
    requests = request_bodies(spark, sf_dir, defects)
    if batches > 1:
        requests.write.parquet(f"{base}/requests")
        requests = read_requests(spark, f"{base}/requests")
    for n in range(batches):
        store.append(requests.where(F.col("request_id").cast("bigint") % batches == n))
    return store


_STORES: dict[tuple, LogStore] = {}


def _store(spark: SparkSession, sf_dir: str, defects: bool = False) -> LogStore:
    """One store per session and table folder, for the queries that only read it."""
    key = (spark.sparkContext.applicationId, sf_dir, defects)
    if key not in _STORES:
        _STORES[key] = _new_store(spark, sf_dir, defects)
    return _STORES[key]


def _coarse_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """A store whose days before the 20th have minutes and hours, the others seconds only."""
    key = (spark.sparkContext.applicationId, sf_dir, "coarse")
    if key not in _STORES:
        store = _new_store(spark, sf_dir, batches=2)
        build_coarse(store, COARSE_BEFORE)
        _STORES[key] = store
    return _STORES[key]


def _filtered_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """A store of two batches, whose files have filters on the days before the 20th."""
    key = (spark.sparkContext.applicationId, sf_dir, "filtered")
    if key not in _STORES:
        store = _new_store(spark, sf_dir, batches=2)
        build_filters(store, COARSE_BEFORE)
        _STORES[key] = store
    return _STORES[key]


def _naive(frame: DataFrame, *columns: str) -> DataFrame:
    """UTC timestamps without zone, as the SQL side has them."""
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# -- search -----------------------------------------------------------------


def _search(params: dict[str, str], all_rows: bool = True, source=logs_from_events) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = parse_search_params(params)
        return search_logs(source(spark, sf_dir), replace(options, limit=None) if all_rows else options)

    return run


PAGED = parse_search_params({"level": "info", "limit": "1000"})


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole search with the number of each row's page."""
    return paged_logs(_ties(spark, sf_dir), PAGED).select(*LOG_COLUMNS, "page")


def _page_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursors that open the pages of the same search."""
    return page_starts(paged_logs(_ties(spark, sf_dir), PAGED), PAGED.limit)


def _store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages over stored logs, with a filter that counters do not answer."""
    found = _store(spark, sf_dir).pages(parse_search_params({"service": "svc-3", "q": "view", "limit": "1000"}))
    return _naive(found.select(*LOG_FIELDS, "page"), "timestamp")


def _day_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and counters per day as three batches and a compaction left them in the commit record,
    beside those that the tables hold."""
    store = _new_store(spark, sf_dir, batches=3)
    compact(store, "log_rollup_1s", RETENTION_NOW.date())
    recorded = [(day, *size) for day, size in store.last_commit().stats.items()]
    recorded = spark.createDataFrame(recorded, "day STRING, rows BIGINT, counters BIGINT")
    held = store.logs().groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("stored_rows"))
    return recorded.join(held, "day", "full")


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_from_events(spark, sf_dir)
    return logs.select("id", cursor_column(F.col("timestamp"), F.col("id")).alias("cursor"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_logs(_search({"level": "warn"})(spark, sf_dir))


def _store_search(params: dict[str, str], all_rows: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = parse_search_params(params)
        found = _store(spark, sf_dir).search(replace(options, limit=None) if all_rows else options)
        return _naive(found.select(*LOG_FIELDS), "timestamp")

    return run


def _filtered_search(params: dict[str, str]) -> Query:
    """A whole search that leaves out files by their filters."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = replace(parse_search_params(params), limit=None)
        found = _filtered_store(spark, sf_dir).search(options, use_filters=True)
        return _naive(found.select(*LOG_FIELDS), "timestamp")

    return run


# -- aggregation ------------------------------------------------------------


def _aggregate(params: dict[str, str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate_logs(logs_from_events(spark, sf_dir), parse_aggregate_params(params))

    return run


def _store_aggregate(params: dict[str, str], use_rollup: bool | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _coarse_store(spark, sf_dir) if use_rollup else _store(spark, sf_dir)
        return _naive(store.aggregate(parse_aggregate_params(params), use_rollup), "start")

    return run


def _coarse(table: str) -> Query:
    """Stored minutes or hours."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counters = _coarse_store(spark, sf_dir).table(table)
        return _naive(counters.select("bucket_start", "service", "level", "count"), "bucket_start")

    return run


def _agg_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = {**RANGE, "bucket": "1h", "group_by": "service"}
    return rendered_buckets(aggregate_raw(logs_from_events(spark, sf_dir), parse_aggregate_params(params)))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_1s(logs_from_events(spark, sf_dir))


def _merged_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of rows that share whole hours, kept per slice of ids, then added up."""
    logs = _ties(spark, sf_dir).withColumn("slice", F.col("id") % 5)
    return merge_deltas(rollup_1s(logs, "slice").drop("slice"))


# -- ingestion --------------------------------------------------------------


def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = validate_requests(request_bodies(spark, sf_dir, defects=True))
    return entries.select(F.col("request_id").cast("bigint").alias("request_id"), "index", "reason")


def _responses(responses: DataFrame) -> DataFrame:
    rejected = F.transform(
        "rejected", lambda r: F.concat(r["index"].cast("string"), F.lit(": "), r["reason"])
    )
    return responses.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        "status",
        "accepted",
        F.size("rejected").alias("rejected"),
        F.array_join(rejected, "; ").alias("reasons"),
        "error",
    )


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(summarise_requests(validate_requests(request_bodies(spark, sf_dir, defects=True))))


def _malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole request bodies damaged in one way per remainder of the request number."""
    requests = request_bodies(spark, sf_dir)
    kind = F.col("request_id").cast("bigint") % 7
    body = (
        F.when(kind == 1, F.expr("left(body, length(body) - 2)"))
        .when(kind == 2, F.concat("body", F.lit(" x")))
        .when(kind == 3, F.concat(F.lit("["), "body", F.lit("]")))
        .when(kind == 4, F.regexp_replace("body", '^."logs":', '{"log":'))
        .when(kind == 5, F.lit('{"logs":[]}'))
        .when(kind == 6, F.concat(F.lit('{"logs":'), F.to_json(F.struct("body")), F.lit("}")))
        .otherwise(F.col("body"))
    )
    return _responses(summarise_requests(validate_requests(requests.withColumn("body", body))))


def _ingested_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(_store(spark, sf_dir, defects=True).logs().select(*LOG_FIELDS), "timestamp")


def _ingested_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(_store(spark, sf_dir, defects=True).responses())


def _ingested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_deltas(_store(spark, sf_dir, defects=True).rollup())
    return _naive(merged, "bucket_start")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional attribute values through ingestion: plain text, no trailing zeros."""
    events = read_events(spark, sf_dir)
    entry = F.to_json(
        F.struct(
            F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
            F.lit("info").alias("level"),
            F.lit("svc").alias("service"),
            F.col("event_id").cast("string").alias("message"),
            F.struct(F.col("value").alias("value")).alias("attributes"),
        )
    )
    requests = events.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.concat(F.lit('{"logs":['), entry, F.lit("]}")).alias("body"),
        F.lit("2024-02-01T00:00:00Z").cast("timestamp").alias("received_at"),
    )
    return validate_requests(requests).select(
        F.col("message").cast("bigint").alias("event_id"), F.col("attr_text")["value"].alias("value")
    )


def _streamed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request files taken as a stream of micro-batches, then taken again after a
    replay of the last one; the counters come out the same."""
    base = scratch_dir(spark, "stream")
    requests = request_bodies(spark, sf_dir)
    requests.repartition(4, "request_id").write.parquet(f"{base}/requests")
    store = LogStore(spark, f"{base}/store")
    stream = stream_requests(spark, f"{base}/requests", max_files_per_trigger=2)
    start_ingest(stream, store, f"{base}/checkpoint", "requests").awaitTermination()
    replayed = store.last_commit().sources["requests"]
    store.append(read_requests(spark, f"{base}/requests"), "requests", replayed)
    return _naive(merge_deltas(store.rollup()), "bucket_start")


def _two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds into one store, the second batch of each while the other's is under way, one replayed."""
    store = LogStore(spark, f"{scratch_dir(spark, 'two')}/store")
    requests = request_bodies(spark, sf_dir)
    number = F.col("request_id").cast("bigint") % 4

    def feed(name: str, first: int) -> None:
        for version in (0, 1, 1):
            LogStore(spark, store.root).append(requests.where(number == first + 2 * version), name, version)

    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(feed, "left", 0), pool.submit(feed, "right", 1)]:
            done.result()
    return _naive(store.logs().select(*LOG_FIELDS), "timestamp")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store notes of three batches of two feeds, one of them given twice and one that fails first."""
    store = LogStore(spark, f"{scratch_dir(spark, 'attempts')}/store")
    requests = request_bodies(spark, sf_dir, defects=True)
    part = F.col("request_id").cast("bigint") % 3
    with suppress(Exception):
        store.append(requests.where(part == 0).withColumn("received_at", F.lit(None).cast("timestamp")), "left", 0)
    for name, version, kept in (("left", 0, part == 0), ("left", 1, part == 1), ("left", 1, part == 1), ("right", 0, part == 2)):
        store.append(requests.where(kept), name, version)
    report = ingest_report(store.attempts())
    return report.select("source", "committed", "replayed", "failed", "retried", "accepted", "rejected")


def _edge_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps of UTC year 0 and 10000 beside good ones, through ingestion."""
    events = read_events(spark, sf_dir)
    moments = ["0000-06-01T00:00:00Z", "0001-01-01T00:00:00+05:00", "9999-12-31T23:59:59-01:00", "0001-01-01T05:00:00+05:00", "2024-01-01"]
    moment = F.element_at(F.array(*map(F.lit, moments)), (F.col("event_id") % len(moments) + 1).cast("int"))
    entry = F.to_json(F.struct(moment.alias("timestamp"), F.lit("info").alias("level"), F.lit("svc").alias("service"), F.col("event_type").alias("message")))
    requests = events.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.concat(F.lit('{"logs":['), entry, F.lit("]}")).alias("body"),
        F.lit("2024-02-01T00:00:00Z").cast("timestamp").alias("received_at"),
    )
    store = LogStore(spark, f"{scratch_dir(spark, 'years')}/store")
    store.append(requests)
    stored = store.logs().groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"))
    refused = store.responses().where("status = 400").select(F.col("rejected")[0]["reason"].alias("day"))
    return stored.unionAll(refused.groupBy("day").agg(F.count("*").alias("rows")))


# -- maintenance ------------------------------------------------------------


def _retained(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _new_store(spark, sf_dir)
        drop_expired(store, RETENTION_NOW, retention_days=7)
        if table == "logs":
            return _naive(store.logs().select(*LOG_FIELDS), "timestamp")
        return _naive(merge_deltas(store.rollup()), "bucket_start")

    return run


def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark, sf_dir)
    names = run_maintenance(store, RETENTION_NOW, retention_days=7)["dropped"]
    return spark.createDataFrame([(n,) for n in names], "partition STRING")


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and size of each daily partition."""
    store = _store(spark, sf_dir)
    counts = store.logs().groupBy("day").agg(F.count("*").alias("rows"))
    return counts.select(partition_name_column(F.col("day")).alias("partition"), "rows")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of three batches after compaction, read without adding up."""
    store = _new_store(spark, sf_dir, batches=3)
    compact(store, "log_rollup_1s", RETENTION_NOW.date())
    return _naive(store.rollup().select("bucket_start", "service", "level", "count"), "bucket_start")


def _compacted_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark, sf_dir, batches=2)
    compact(store, "logs", RETENTION_NOW.date())
    return _naive(store.logs().select(*LOG_FIELDS), "timestamp")


def _mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters rebuilt from rows, on days that got a part of their counters twice."""
    store = _new_store(spark, sf_dir, batches=2)
    batch_id, _ = store.reserve()
    store.write("log_rollup_1s", store.rollup().where("day >= '2024-01-10' AND level = 'warn'"), batch_id)
    store.commit(lambda state: state.with_batch(batch_id))
    rebuild_counters(store, RETENTION_NOW.date())
    return _naive(merge_deltas(store.rollup()), "bucket_start")


# -- registry ---------------------------------------------------------------

COMBINED = {
    "service": "svc-3", "level": "info", "since": "2024-01-03T00:00:00Z",
    "until": "2024-01-29T00:00:00Z", "q": "SIGN", "attr.k": "42",
}
KEYSET = {"cursor": Cursor(datetime(2024, 1, 16, 1, 3, 34, 557814, timezone.utc), 5000).encode()}


def entry(spark: SparkSession) -> DataFrame:
    return _aggregate({**RANGE, "bucket": "1h", "group_by": "service"})(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "search_latest": _search({}, all_rows=False),
        "search_limit_prefix": _search({"limit": "10abc"}, all_rows=False),
        "search_service": _search({"service": "svc-3"}),
        "search_level": _search({"level": "error"}),
        "search_time_range": _search({"since": "2024-01-05", "until": "2024-01-20"}),
        "search_message": _search({"q": "PURCHASE"}),
        "search_message_wildcard": _search({"q": "U_ER 14"}),
        "search_attr": _search({"attr.k": "42"}),
        "search_attr_dotted": _search({"attr.user.id": "42", "attr.even": "true"}, source=_dotted),
        "search_attr_dashed": _search({"attr.user-id": "u17"}, source=_dotted),
        "search_combined": _search(COMBINED),
        "search_keyset_page": _search({**KEYSET, "limit": "10"}, all_rows=False),
        "search_keyset_rest": _search(KEYSET, source=_ties),
        "search_tie_break": _search({"service": "svc-3"}, source=_ties),
        "search_pages": _pages,
        "search_page_starts": _page_starts,
        "store_day_sizes": _day_sizes,
        "store_search_pages": _store_pages,
        "search_cursors": _cursors,
        "search_rendered": _rendered,
        "store_search_latest": _store_search({"limit": "1000"}),
        "store_search_service_level": _store_search({"service": "svc-5", "level": "warn", "limit": "50"}),
        "store_search_until": _store_search({"until": "2024-01-15T12:30:15.25Z", "level": "error"}),
        "store_search_attr": _store_search({"attr.k": "42"}, all_rows=True),
        "store_filters_attr": _filtered_search({"attr.k": "42"}),
        "store_filters_message": _filtered_search({"q": "ChAsE BY u_er 4"}),
        "store_filters_both": _filtered_search({"q": "sign", "attr.k": "7"}),
        "agg_attr_and_q": _aggregate(
            {"since": "2024-01-03", "until": "2024-01-27", "bucket": "1d", "group_by": "service",
             "attr.k": "69", "q": "ERR"}
        ),
        "agg_filtered": _aggregate({**RANGE, "bucket": "1h", "service": "svc-2", "level": "error"}),
        "agg_rendered": _agg_rendered,
        "agg_rollup_unaligned": _store_aggregate({**RANGE, "bucket": "1h"}, use_rollup=True),
        "agg_rollup_by_service": _store_aggregate({**RANGE, "bucket": "1d", "group_by": "service"}, use_rollup=True),
        "agg_rollup_by_level": _store_aggregate({**RANGE, "bucket": "5m", "group_by": "level"}, use_rollup=True),
        "agg_rollup_filtered": _store_aggregate(
            {**RANGE, "bucket": "1m", "service": "svc-2", "level": "error"}, use_rollup=True
        ),
        "agg_rollup_hours_by_level": _store_aggregate({**RANGE, "bucket": "1h", "group_by": "level", "service": "svc-4"}, use_rollup=True),
        "rollup_minutes": _coarse("log_rollup_1m"),
        "rollup_hours": _coarse("log_rollup_1h"),
        "store_agg_by_service": _store_aggregate({**RANGE, "bucket": "1h", "group_by": "service"}),
        "store_agg_by_level": _store_aggregate({**RANGE, "bucket": "1m", "group_by": "level"}),
        "store_agg_attr": _store_aggregate({**RANGE, "bucket": "1d", "attr.k": "42"}),
        "rollup_1s": _rollup,
        "rollup_merge": _merged_deltas,
        "validate_entries": _validate,
        "ingest_summary": _summary,
        "ingest_malformed": _malformed,
        "ingest_logs": _ingested_logs,
        "ingest_responses": _ingested_responses,
        "ingest_rollup": _ingested_rollup,
        "ingest_numbers": _numbers,
        "ingest_two_sources": _two_sources,
        "ingest_edge_years": _edge_years,
        "ingest_attempts": _attempts,
        "stream_rollup": _streamed_rollup,
        "retention_kept": _retained("logs"),
        "retention_rollup_kept": _retained("log_rollup_1s"),
        "retention_dropped": _dropped,
        "partition_names": _partitions,
        "compact_rollup": _compacted,
        "compact_logs": _compacted_logs,
        "counters_mended": _mended,
    }
    for bucket in ("1m", "5m", "1h", "1d"):
        found[f"agg_{bucket}"] = _aggregate({**RANGE, "bucket": bucket})
        for group in ("service", "level"):
            found[f"agg_{bucket}_by_{group}"] = _aggregate({**RANGE, "bucket": bucket, "group_by": group})
    if llm:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return found


# -- SQL ---------------------------------------------------------------------

_LEVEL = (
    "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' "
    "WHEN 'view' THEN 'debug' ELSE 'info' END"
)
_FIELDS = (
    f"{_LEVEL} AS level, 'svc-' || (user_id % 7) AS service, "
    "event_type || ' by user ' || user_id AS message"
)
_LOGS = f"(SELECT event_id AS id, ts AS \"timestamp\", {_FIELDS}, props AS attributes, user_id FROM events)"
_TIES = (
    f"(SELECT event_id AS id, date_trunc('hour', ts) AS \"timestamp\", {_FIELDS}, "
    "props AS attributes FROM events)"
)
# What the store returns: attributes as canonical JSON, no id.
_STORED = (
    f"(SELECT event_id, ts AS \"timestamp\", {_FIELDS}, "
    "'{\"k\":' || (props->>'k') || '}' AS attributes FROM events)"
)
_STORED_FIELDS = '"timestamp", level, service, message, attributes'
_ROW = f"id, {_STORED_FIELDS}"
_NEWEST = 'ORDER BY "timestamp" DESC, id DESC'
_IN_RANGE = "\"timestamp\" >= TIMESTAMP '2024-01-03 04:05:06.7' AND \"timestamp\" < TIMESTAMP '2024-01-27 08:09:10.3'"
_INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
_REASON = """CASE event_id % 12
    WHEN 3 THEN 'Entry must be an object'
    WHEN 4 THEN 'Missing or invalid timestamp'
    WHEN 5 THEN 'Timestamp must be a valid ISO 8601 string'
    WHEN 6 THEN 'Timestamp cannot be more than 5 minutes in the future'
    WHEN 7 THEN 'Invalid level: ''critical'''
    WHEN 8 THEN 'Service must be a non-empty string'
    WHEN 9 THEN 'Message must be a non-empty string'
    WHEN 10 THEN 'Attributes must be a flat object'
    WHEN 11 THEN 'Attribute ''z'' has invalid type ''object''' END"""
_VERDICTS = (
    "(SELECT event_id // 40 AS request_id, "
    "CAST(row_number() OVER (PARTITION BY event_id // 40 ORDER BY event_id) - 1 AS INTEGER) AS \"index\", "
    f"{_REASON} AS reason FROM events)"
)
_SUMMARY = (
    "SELECT request_id, CAST(CASE WHEN count(*) = count(reason) THEN 400 ELSE 200 END AS INTEGER) AS status, "
    "CAST(count(*) - count(reason) AS INTEGER) AS accepted, CAST(count(reason) AS INTEGER) AS rejected, "
    "coalesce(string_agg(\"index\" || ': ' || reason, '; ' ORDER BY \"index\") FILTER (reason IS NOT NULL), '') AS reasons, "
    f"CAST(NULL AS VARCHAR) AS error FROM {_VERDICTS} GROUP BY request_id"
)


def _sql_search(where: str = "TRUE", limit: int | None = None, source: str = _LOGS) -> str:
    tail = f" LIMIT {limit}" if limit else ""
    return f"SELECT {_ROW} FROM {source} WHERE {where} {_NEWEST}{tail}"


def _sql_stored(where: str = "TRUE", limit: int | None = None) -> str:
    tail = f'ORDER BY "timestamp" DESC LIMIT {limit}' if limit else ""
    return f"SELECT {_STORED_FIELDS} FROM {_STORED} WHERE {where} {tail}"


def _sql_aggregate(bucket: str, group: str | None = None, where: str = _IN_RANGE, start: str | None = None) -> str:
    binned = f"time_bucket(INTERVAL '{_INTERVALS[bucket]}', \"timestamp\", TIMESTAMP '2026-01-01')"
    start = (start or "{}").format(binned)
    key = group or "CAST(NULL AS VARCHAR)"
    return (
        f'SELECT {start} AS start, {key} AS "group", count(*) AS count '
        f"FROM {_LOGS} WHERE {where} GROUP BY ALL"
    )


def _sql_rollup(source: str, where: str = "TRUE", width: str = "second") -> str:
    return (
        f"SELECT date_trunc('{width}', \"timestamp\") AS bucket_start, service, level, count(*) AS count "
        f"FROM {source} WHERE {where} GROUP BY ALL"
    )


def oracle_sql() -> dict[str, str]:
    kept = "\"timestamp\" >= TIMESTAMP '2024-01-24'"
    body_error = """CASE WHEN event_id // 40 % 7 IN (1, 2) THEN 'Request body is not valid JSON'
        WHEN event_id // 40 % 7 IN (3, 4, 6) THEN 'Request body must be an object with a "logs" array'
        WHEN event_id // 40 % 7 = 5 THEN 'Logs array cannot be empty' END"""
    found = {
        "search_latest": _sql_search(limit=100),
        "search_limit_prefix": _sql_search(limit=10),
        "search_service": _sql_search("service = 'svc-3'"),
        "search_level": _sql_search("level = 'error'"),
        "search_time_range": _sql_search(
            "\"timestamp\" >= TIMESTAMP '2024-01-05' AND \"timestamp\" < TIMESTAMP '2024-01-20'"
        ),
        "search_message": _sql_search("message ILIKE '%PURCHASE%'"),
        "search_message_wildcard": _sql_search("message ILIKE '%U_ER 14%'"),
        "search_attr": _sql_search("attributes->>'k' = '42'"),
        "search_attr_dotted": f"""SELECT id, "timestamp", level, service, message,
            '{{"user":{{"id":"42"}},"user.id":' || user_id || ',"user-id":"u' || user_id || '","even":'
            || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS attributes
            FROM {_LOGS} WHERE user_id = 42""",
        "search_attr_dashed": f"""SELECT id, "timestamp", level, service, message,
            '{{"user":{{"id":"42"}},"user.id":' || user_id || ',"user-id":"u' || user_id || '","even":'
            || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS attributes
            FROM {_LOGS} WHERE user_id = 17""",
        "search_combined": _sql_search(
            "service = 'svc-3' AND level = 'info' AND \"timestamp\" >= TIMESTAMP '2024-01-03' "
            "AND \"timestamp\" < TIMESTAMP '2024-01-29' AND message ILIKE '%SIGN%' AND attributes->>'k' = '42'"
        ),
        "search_keyset_page": _sql_search(
            "(\"timestamp\", id) < (TIMESTAMP '2024-01-16 01:03:34.557814', 5000)", 10
        ),
        "search_keyset_rest": _sql_search(
            "(\"timestamp\", id) < (TIMESTAMP '2024-01-16 01:03:34.557814', 5000)", source=_TIES
        ),
        "search_tie_break": _sql_search("service = 'svc-3'", source=_TIES),
        "search_pages": (
            f"SELECT {_ROW}, CAST((row_number() OVER ({_NEWEST}) - 1) // 1000 AS INTEGER) AS page "
            f"FROM {_TIES} WHERE level = 'info'"
        ),
        "search_page_starts": (
            "SELECT CAST(n // 1000 AS INTEGER) AS page, "
            "to_base64(encode(strftime(before_ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z|' || before_id)) AS cursor FROM ("
            f"SELECT row_number() OVER ({_NEWEST}) - 1 AS n, lag(\"timestamp\") OVER ({_NEWEST}) AS before_ts, "
            f"lag(id) OVER ({_NEWEST}) AS before_id FROM {_TIES} WHERE level = 'info') WHERE n % 1000 = 0"
        ),
        "store_day_sizes": (
            "SELECT strftime(\"timestamp\", '%Y-%m-%d') AS day, count(*) AS rows, "
            "count(DISTINCT (date_trunc('second', \"timestamp\"), service, level)) AS counters, count(*) AS stored_rows "
            f"FROM {_STORED} GROUP BY ALL"
        ),
        "store_search_pages": (
            f"SELECT {_STORED_FIELDS}, CAST((row_number() OVER (ORDER BY \"timestamp\" DESC) - 1) // 1000 AS INTEGER) AS page "
            f"FROM {_STORED} WHERE service = 'svc-3' AND message ILIKE '%view%'"
        ),
        "search_cursors": (
            "SELECT event_id AS id, to_base64(encode(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z|' || event_id)) "
            "AS cursor FROM events"
        ),
        "search_rendered": (
            f"SELECT CAST(id AS VARCHAR) AS id, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"timestamp\", "
            f"level, service, message, attributes FROM {_LOGS} WHERE level = 'warn'"
        ),
        "store_search_latest": _sql_stored(limit=1000),
        "store_search_service_level": _sql_stored("service = 'svc-5' AND level = 'warn'", 50),
        "store_search_until": _sql_stored(
            "level = 'error' AND \"timestamp\" < TIMESTAMP '2024-01-15 12:30:15.25'", 100
        ),
        "store_search_attr": _sql_stored("attributes = '{\"k\":42}'"),
        "store_filters_attr": _sql_stored("attributes = '{\"k\":42}'"),
        "store_filters_message": _sql_stored("message ILIKE '%chase by u_er 4%'"),
        "store_filters_both": _sql_stored("message ILIKE '%sign%' AND attributes = '{\"k\":7}'"),
        "agg_attr_and_q": _sql_aggregate(
            "1d", "service",
            "\"timestamp\" >= TIMESTAMP '2024-01-03' AND \"timestamp\" < TIMESTAMP '2024-01-27' "
            "AND attributes->>'k' = '69' AND message ILIKE '%ERR%'",
        ),
        "agg_filtered": _sql_aggregate("1h", None, _IN_RANGE + " AND service = 'svc-2' AND level = 'error'"),
        "agg_rendered": _sql_aggregate("1h", "service", start="strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"),
        "agg_rollup_unaligned": _sql_aggregate("1h"),
        "agg_rollup_by_service": _sql_aggregate("1d", "service"),
        "agg_rollup_by_level": _sql_aggregate("5m", "level"),
        "agg_rollup_filtered": _sql_aggregate(
            "1m", None, _IN_RANGE + " AND service = 'svc-2' AND level = 'error'"
        ),
        "agg_rollup_hours_by_level": _sql_aggregate("1h", "level", _IN_RANGE + " AND service = 'svc-4'"),
        "rollup_minutes": _sql_rollup(_LOGS, "\"timestamp\" < TIMESTAMP '2024-01-20'", "minute"),
        "rollup_hours": _sql_rollup(_LOGS, "\"timestamp\" < TIMESTAMP '2024-01-20'", "hour"),
        "store_agg_by_service": _sql_aggregate("1h", "service"),
        "store_agg_by_level": _sql_aggregate("1m", "level"),
        "store_agg_attr": _sql_aggregate("1d", None, _IN_RANGE + " AND attributes->>'k' = '42'"),
        "rollup_1s": _sql_rollup(_LOGS),
        "rollup_merge": _sql_rollup(_TIES),
        "validate_entries": f'SELECT request_id, "index", reason FROM {_VERDICTS}',
        "ingest_summary": _SUMMARY,
        "ingest_malformed": (
            "SELECT event_id // 40 AS request_id, "
            f"CAST(CASE WHEN {body_error} IS NULL THEN 200 ELSE 400 END AS INTEGER) AS status, "
            f"CAST(CASE WHEN {body_error} IS NULL THEN count(*) ELSE 0 END AS INTEGER) AS accepted, "
            f"CAST(0 AS INTEGER) AS rejected, '' AS reasons, {body_error} AS error FROM events GROUP BY event_id // 40"
        ),
        "ingest_logs": _sql_stored("event_id % 12 < 3"),
        "ingest_responses": _SUMMARY,
        "ingest_rollup": _sql_rollup(_STORED, "event_id % 12 < 3"),
        "ingest_numbers": (
            "SELECT event_id, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS value FROM events"
        ),
        "stream_rollup": _sql_rollup(_LOGS),
        "retention_kept": _sql_stored(kept),
        "retention_rollup_kept": _sql_rollup(_LOGS, kept),
        "retention_dropped": (
            "SELECT DISTINCT strftime(ts, 'logs_y%Ym%md%d') AS partition FROM events "
            "WHERE ts < TIMESTAMP '2024-01-24'"
        ),
        "partition_names": "SELECT strftime(ts, 'logs_y%Ym%md%d') AS partition, count(*) AS rows FROM events GROUP BY ALL",
        "ingest_two_sources": _sql_stored(),
        "ingest_edge_years": """SELECT CASE WHEN event_id % 5 = 3 THEN '0001-01-01' WHEN event_id % 5 = 4 THEN '2024-01-01'
            ELSE 'Timestamp must be a valid ISO 8601 string' END AS day, count(*) AS rows FROM events GROUP BY ALL""",
        "ingest_attempts": f"""SELECT CASE WHEN request_id % 3 = 2 THEN 'right' ELSE 'left' END AS source,
            count(DISTINCT request_id % 3) AS committed, CASE WHEN max(request_id % 3) = 2 THEN 0 ELSE 1 END AS replayed,
            CASE WHEN max(request_id % 3) = 2 THEN 0 ELSE 1 END AS failed, CASE WHEN max(request_id % 3) = 2 THEN 0 ELSE 1 END AS retried,
            count(*) - count(reason) AS accepted, count(reason) AS rejected FROM {_VERDICTS} GROUP BY 1""",
        "compact_rollup": _sql_rollup(_LOGS),
        "compact_logs": _sql_stored(),
        "counters_mended": _sql_rollup(_LOGS),
    }
    for bucket in _INTERVALS:
        found[f"agg_{bucket}"] = _sql_aggregate(bucket)
        for group in ("service", "level"):
            found[f"agg_{bucket}_by_{group}"] = _sql_aggregate(bucket, group)
    if llm:
        found |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
