"""Log ingestion, search and time-bucket aggregation expressed as Spark jobs."""

from emberlog.operators.aggregate import aggregate_logs
from emberlog.operators.search import search_logs, search_page
from emberlog.operators.validate import summarise_requests, validate_requests
from emberlog.plans.errors import InvalidQueryError
from emberlog.plans.options import (
    AggregateOptions,
    AttrFilter,
    Cursor,
    SearchOptions,
    parse_aggregate_params,
    parse_search_params,
)
from emberlog.session import configure, scratch_dir
from emberlog.sources.store import LogStore

__all__ = [
    "AggregateOptions",
    "AttrFilter",
    "Cursor",
    "InvalidQueryError",
    "LogStore",
    "SearchOptions",
    "aggregate_logs",
    "configure",
    "parse_aggregate_params",
    "parse_search_params",
    "scratch_dir",
    "search_logs",
    "search_page",
    "summarise_requests",
    "validate_requests",
]
