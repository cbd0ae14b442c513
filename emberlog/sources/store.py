"""The stored tables: logs, their 1-second counters, and per-request responses.

All three are Parquet, partitioned by (day, batch_id). A batch becomes visible in
all of them at once, when a commit record names it: readers keep to the batches
the newest record knows, so a half-written batch is never seen.

Several writers may work at a time. Batch numbers and id ranges are reserved, and
commit records put in place, by creating a file that must not exist; whoever comes
second reads the newer record and tries again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, time, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.util import inheritable_thread_target

from emberlog.functions.timestamps import last_before, utc_date
from emberlog.operators.aggregate import aggregate_logs, aggregate_pieces
from emberlog.operators.filters import time_range, where_all
from emberlog.operators.search import (
    Page,
    as_page,
    matching_logs,
    newest_from_counters,
    paged_logs,
    probe_rows,
    search_logs,
)
from emberlog.operators.validate import summarise_requests, validate_requests
from emberlog.operators.rollup import rollup_1s, split_range
from emberlog.operators.terms import asked_terms, file_column, file_filters, files_without
from emberlog.plans.options import AggregateOptions, SearchOptions, decode_cursor
from emberlog.schema import BUCKET_SECONDS, COARSE_TABLES, FILTER_SCHEMA, METRICS_SCHEMA, PARTITION_COLUMNS, TABLE_SCHEMAS, TABLE_SCHEMAS_COARSE
from emberlog.session import configure
from emberlog.sources import paths

KEPT_RECORDS = 100
#: Rows that are scanned in about the time of one more job: below them, nothing is asked first.
JOB_ROWS = 1_000_000
SORT_KEYS = {
    "logs": ("timestamp", "id"),
    "log_rollup_1s": ("bucket_start", "service", "level"),
    "responses": ("received_at",),
    "log_rollup_1m": ("bucket_start", "service", "level"),
    "log_rollup_1h": ("bucket_start", "service", "level"),
}
SCHEMAS = TABLE_SCHEMAS | TABLE_SCHEMAS_COARSE
#: About the bytes of a row while a task sorts it; rows of a few bytes in a file or shuffle may take hundreds.
COUNTER_BYTES = "160 + octet_length(service)"
ROW_BYTES = dict.fromkeys(SCHEMAS, COUNTER_BYTES) | {
    "logs": "200 + octet_length(service) + octet_length(message) + 4 * octet_length(attributes)",
    "responses": "160 + octet_length(request_id) + coalesce(octet_length(error), 0)"
    " + aggregate(rejected, 0L, (n, r) -> n + 64 + octet_length(r.reason))",
}
#: The same of a response, by its staged entries.
RESPONSE_BYTES = """CASE WHEN coalesce(index, 0) = 0 THEN 160 + coalesce(octet_length(request_id), 0) + coalesce(octet_length(error), 0)
    ELSE 0 END + coalesce(64 + octet_length(reason), 0)"""
#: Such bytes that one task of a write sorts.
TASK_BYTES = 1 << 28


@dataclass(frozen=True)
class Commit:
    """State of the store. Each record is complete, so only the newest is read.

    Batches up to `batch_id` are visible, but for the `missing` ones, which other
    writers have reserved or given up. `sources` holds the last version taken from
    each named input. `compacted` maps table to day to what a rewrite replaced:
    batches up to `upto`, but for those `late` then. Days before `cutoff` are gone.
    `stats` maps each day to its visible log rows and counter rows; None in a record
    written before they were kept, until maintenance counts them. `coarse` says in which
    batch each day's minutes and hours are, how many, and which `size` the day had then:
    they hold as long as it has that size.
    """

    version: int = -1
    batch_id: int = -1
    missing: list[int] = field(default_factory=list)
    sources: dict[str, int] = field(default_factory=dict)
    compacted: dict[str, dict[str, dict]] = field(default_factory=dict)
    cutoff: str | None = None
    accepted: int = 0
    rejected: int = 0
    stats: dict[str, list[int]] | None = None
    coarse: dict[str, dict] = field(default_factory=dict)

    def coarse_days(self, days: Iterable[date]) -> list[date]:
        """Of the days, those whose minutes and hours cover all their rows."""
        known = self.stats or {}
        entries = {day: self.coarse.get(day.isoformat()) for day in days}
        return [day for day, entry in entries.items() if entry and entry["size"] == known.get(day.isoformat())]

    def with_stats(self, added: dict[str, list[int]]) -> Commit:
        """With these numbers added per day; unknown ones stay unknown."""
        if self.stats is None:
            return self
        days = {**{d: [0, 0] for d in added}, **self.stats}
        total = {d: [a + b for a, b in zip(n, added.get(d, (0, 0)))] for d, n in days.items()}
        return replace(self, stats={d: n for d, n in sorted(total.items()) if any(n)})

    def size(self, days: Iterable[date]) -> tuple[int, int] | None:
        """Log rows and counter rows of these days, if known."""
        if self.stats is None:
            return None
        held = [self.stats.get(day.isoformat(), (0, 0)) for day in days]
        return sum(n[0] for n in held), sum(n[1] for n in held)

    def with_batch(self, batch_id: int) -> Commit:
        top = max(self.batch_id, batch_id)
        missing = {*self.missing, *range(self.batch_id + 1, top)} - {batch_id}
        return replace(self, batch_id=top, missing=sorted(missing))

    def replaced(self, table: str, day: str, batch_id: int) -> bool:
        """Whether a rewrite of the day holds this batch's rows."""
        entry = self.compacted.get(table, {}).get(day)
        return entry is not None and batch_id <= entry["upto"] and batch_id not in entry["late"]


def _touches(day: date, ranges: list[tuple[datetime, datetime]]) -> bool:
    """Whether a UTC day shares a moment with one of the ranges."""
    return any(utc_date(start) <= day <= utc_date(last_before(end)) for start, end in ranges)


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        #: Bytes that rows about to be written take to sort, by (table, batch number), where they were counted before.
        self._sizes: dict[tuple[str, int], int] = {}

    # -- records ------------------------------------------------------------

    def _newest(self, kind: str) -> dict:
        """The newest record of a chain; {} before the first."""
        folder = f"{self.root}/{kind}"
        while found := paths.names(self.spark, folder):
            text = paths.read(self.spark, f"{folder}/{found[-1]}")
            if text is not None:  # else others have moved far on meanwhile
                return json.loads(text)
        return {}

    def _publish(self, kind: str, record: dict) -> bool:
        folder = f"{self.root}/{kind}"
        if not paths.publish(self.spark, folder, f"{record['version']:012d}.json", json.dumps(record)):
            return False
        for name in paths.names(self.spark, folder)[:-KEPT_RECORDS]:
            paths.remove(self.spark, f"{folder}/{name}")
        return True

    def last_commit(self) -> Commit:
        return Commit(**(self._newest("commits") or {"stats": {}}))

    def commit(self, change: Callable[[Commit], Commit | None]) -> Commit | None:
        """Apply a change to the newest state and make it visible; where another
        writer was faster, again to that one's. A change to None is given up."""
        while True:
            last = self.last_commit()
            changed = change(last)
            if changed is None:
                return None
            record = replace(changed, version=last.version + 1)
            if self._publish("commits", asdict(record)):
                return record

    def reserve(self, ids: int = 0) -> tuple[int, int]:
        """A batch number no other writer has, and the first of so many ids."""
        while True:
            last = self._newest("reservations") or {"version": -1, "next_id": 1}
            record = {"version": last["version"] + 1, "next_id": last["next_id"] + ids}
            if self._publish("reservations", record):
                return record["version"], last["next_id"]

    # -- reading ------------------------------------------------------------

    def folders(self, table: str) -> list[date]:
        """UTC days with a folder, ascending; those past retention too."""
        found = []
        for value in paths.partition_values(self.spark, f"{self.root}/{table}", "day"):
            try:
                found.append(date.fromisoformat(value))
            except ValueError:  # not a folder of this library
                continue
        return sorted(found)

    def days(self, table: str, commit: Commit | None = None) -> list[date]:
        """UTC days with a partition, ascending."""
        cutoff = (commit or self.last_commit()).cutoff
        return [day for day in self.folders(table) if cutoff is None or day.isoformat() >= cutoff]

    def table(self, name: str, days: Iterable[date] | None = None) -> DataFrame:
        """Committed rows. Naming days keeps the file listing to those partitions."""
        return self._visible(name, self.last_commit(), days)

    def _visible(self, name: str, commit: Commit, days: Iterable[date] | None = None) -> DataFrame:
        present = self.days(name, commit)
        chosen = present if days is None else sorted(set(days) & set(present))
        reader = self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.root}/{name}")
        if name in COARSE_TABLES:
            chosen = commit.coarse_days(chosen)
        if not chosen:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name in COARSE_TABLES:
            return reader.parquet(*[f"{self.root}/{name}/day={d}/batch_id={commit.coarse[d.isoformat()]['batch']}" for d in chosen])
        frame = reader.parquet(*[f"{self.root}/{name}/day={d}" for d in chosen])
        return where_all(frame, self._live(name, commit, chosen))

    @staticmethod
    def _live(name: str, commit: Commit, days: list[date]) -> list[Column]:
        batch = F.col("batch_id")
        conditions = [batch <= commit.batch_id]
        if commit.missing:
            conditions.append(~batch.isin(commit.missing))
        rewritten = {d: e for d, e in commit.compacted.get(name, {}).items() if date.fromisoformat(d) in set(days)}
        if rewritten:
            day = F.col("day").cast("string")
            upto = F.create_map(*[F.lit(x) for d, e in rewritten.items() for x in (d, e["upto"])])[day]
            live = batch > F.coalesce(upto, F.lit(-1))
            for d, entry in rewritten.items():
                if entry["late"]:
                    live = live | ((day == d) & batch.isin(entry["late"]))
            conditions.append(live)
        return conditions

    def _between(self, name: str, commit: Commit, since: datetime | None, until: datetime | None) -> DataFrame:
        high = last_before(until) if until else None
        return self._visible(name, commit, self._days_between(name, commit, since, high))

    def _days_between(self, name: str, commit: Commit, first: datetime | None, last: datetime | None) -> list[date]:
        low = utc_date(first) if first else date.min
        high = utc_date(last) if last else date.max
        return [day for day in self.days(name, commit) if low <= day <= high]

    def logs(self) -> DataFrame:
        return self.table("logs")

    def rollup(self) -> DataFrame:
        return self.table("log_rollup_1s")

    def responses(self) -> DataFrame:
        return self.table("responses")

    # -- queries ------------------------------------------------------------

    def search(self, options: SearchOptions, use_filters: bool | None = None) -> DataFrame:
        """search_logs over the store, with the scan bounded by the counters, and by the filters
        over messages and attributes where the days hold many rows; `use_filters` decides otherwise."""
        commit = self.last_commit()
        return search_logs(self._candidates(commit, options, use_filters), options)

    def search_page(self, options: SearchOptions) -> Page:
        """One page. Filters the counters cannot answer walk the days newest first
        and stop once the page is full: days do not overlap in time, so rows of an
        older span all follow those already found."""
        commit, probe = self.last_commit(), replace(options, limit=options.limit + 1)
        if options.counted_by_rollup or self._few_rows(commit, self._searched_days(commit, options)):
            return as_page(probe_rows(self._candidates(commit, probe), probe), options.limit)
        rows = []
        for days in self._newest_days_first("logs", commit, options):
            missing = replace(probe, limit=probe.limit - len(rows))
            rows += probe_rows(self._holding(commit, days, missing), missing)
            if len(rows) == probe.limit:
                break
        return as_page(rows, options.limit)

    def iterate_pages(self, options: SearchOptions) -> Iterator[Page]:
        """Pages from the newest on, following the cursor until it is null."""
        while True:
            page = self.search_page(options)
            yield page
            if page.next_cursor is None:
                return
            options = replace(options, cursor=decode_cursor(page.next_cursor))

    def pages(self, options: SearchOptions) -> DataFrame:
        """paged_logs over the store: all pages of a search, numbered in one job."""
        commit = self.last_commit()
        return paged_logs(self._holding(commit, self._searched_days(commit, options), options), options)

    def create_views(self, prefix: str = "") -> list[str]:
        """Temporary views over the committed rows of each table, by its name."""
        for name in TABLE_SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)
        return [prefix + name for name in TABLE_SCHEMAS]

    def _holding(
        self, commit: Commit, days: list[date], options: SearchOptions | AggregateOptions, use_filters: bool | None = None
    ) -> DataFrame:
        """Log rows of these days, without the files that the filters say hold no match. Files
        without filters are read."""
        logs = self._visible("logs", commit, days)
        if use_filters is None:
            use_filters = not self._few_rows(commit, days)
        if not use_filters or options.counted_by_rollup:
            return logs
        found = self.files_without_match(days, options)
        return logs.where(~file_column().isin(found)) if found else logs

    def files_without_match(self, days: list[date], options: SearchOptions | AggregateOptions) -> list[str]:
        """Files (day, batch and name) of these days that the filters rule out: names only, as the
        file listing of the scan itself has them on the driver."""
        filters = self.filters(days)
        asked = asked_terms(self.spark, options) if filters is not None else {}
        return sorted(row["file"] for row in files_without(filters, asked).collect()) if asked else []

    def filters(self, days: Iterable[date] | None = None) -> DataFrame | None:
        """Filters over the files of these days, also of batches since replaced; None without any."""
        known = self.folders("log_filters")
        chosen = known if days is None else sorted(set(days) & set(known))
        if not chosen:
            return None
        reader = self.spark.read.schema(FILTER_SCHEMA).option("basePath", f"{self.root}/log_filters")
        return reader.parquet(*[f"{self.root}/log_filters/day={day}" for day in chosen])

    def write_filters(self, batches: dict[date, list[int]]) -> None:
        """Filters of the files of these batches of each day, whose files never change. The folder
        of a batch is put in place whole, so it holds all its files' filters or is not there."""
        folders = [f"{self.root}/logs/day={day}/batch_id={batch}" for day, held in batches.items() for batch in held]
        logs = self.spark.read.schema(SCHEMAS["logs"]).option("basePath", f"{self.root}/logs").parquet(*folders)
        rows = file_filters(logs).select(*StructType.fromDDL(FILTER_SCHEMA).names).hint("rebalance", *PARTITION_COLUMNS)
        rows = rows.sortWithinPartitions(*PARTITION_COLUMNS, "kind", "slices", "slice")
        output = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        output.partitionBy(*PARTITION_COLUMNS).parquet(f"{self.root}/log_filters")

    def _candidates(self, commit: Commit, options: SearchOptions, use_filters: bool | None = None) -> DataFrame:
        """Log rows that can be among the newest `limit` matches.

        The commit's statistics bound the days of a search without filters; where few rows are
        left then, they are read as they are. Else counters, or the rows themselves, tell first
        how far back to go.
        """
        since = options.since
        days = self._searched_days(commit, options)
        if options.limit is not None and options.counted_by_rollup and not (options.service or options.level):
            days = self._newest_days_holding(commit, days, options)
            if len(days) < len(self._searched_days(commit, options)):
                since = datetime.combine(days[0], time.min, timezone.utc)
                options = replace(options, since=since)
        if options.limit is None or self._few_rows(commit, days):
            pass
        elif options.counted_by_rollup:
            missing = options.limit
            for days in self._newest_days_first("log_rollup_1s", commit, options):
                counters = self._visible("log_rollup_1s", commit, days)
                found, second = newest_from_counters(counters, options, missing)
                missing -= found
                if missing == 0:
                    since = max(second, since) if since else second
                    break
        else:
            # Nothing counts these; days newest first until enough rows are found.
            missing = options.limit
            for days in self._newest_days_first("logs", commit, options):
                missing -= matching_logs(self._holding(commit, days, options, use_filters), options).limit(missing).count()
                if missing == 0:
                    first = datetime.combine(days[-1], time.min, timezone.utc)
                    since = max(first, since) if since else first
                    break
        logs = self._holding(commit, self._days_between("logs", commit, since, options.last_instant), options, use_filters)
        return where_all(logs, time_range(logs, "timestamp", since, None))

    def _searched_days(self, commit: Commit, options: SearchOptions) -> list[date]:
        return self._days_between("logs", commit, options.since, options.last_instant)

    @staticmethod
    def _few_rows(commit: Commit, days: list[date]) -> bool:
        held = commit.size(days)
        return held is not None and held[0] <= JOB_ROWS

    @staticmethod
    def _newest_days_holding(commit: Commit, days: list[date], options: SearchOptions) -> list[date]:
        """The newest of the days that surely hold `limit` rows of a search without filters. A day
        that the search's bounds may cut counts for nothing."""
        if commit.stats is None:
            return days
        first, last = options.since, options.last_instant
        cut = {utc_date(first)} if first and first.astimezone(timezone.utc).time() != time.min else set()
        cut |= {utc_date(last)} if last and last.astimezone(timezone.utc).time() != time.max else set()
        found = 0
        for k in range(len(days) - 1, -1, -1):
            found += 0 if days[k] in cut else commit.size([days[k]])[0]
            if found >= options.limit:
                return days[k:]
        return days

    def _newest_days_first(self, name: str, commit: Commit, options: SearchOptions) -> Iterator[list[date]]:
        """Days a search may touch, in spans of 1, 2, 4, ... going back."""
        days, span = self._days_between(name, commit, options.since, options.last_instant)[::-1], 1
        while days:
            yield days[:span]
            days, span = days[span:], span * 2

    def aggregate(self, options: AggregateOptions, use_rollup: bool | None = None) -> DataFrame:
        """Buckets from the counters or from raw rows, whichever the commit's statistics say are
        fewer to read; `use_rollup` decides otherwise. Counters need raw rows beside them, on the
        days that hold the two partial seconds."""
        commit = self.last_commit()
        days = self._days_between("logs", commit, options.since, last_before(options.until))
        if use_rollup is None:
            use_rollup = self._counters_pay(commit, days, options.bucket)
        if not (use_rollup and options.counted_by_rollup):
            return aggregate_logs(self._holding(commit, days, options), options)
        return aggregate_pieces(self._pieces(commit, days, options), options)

    def _pieces(self, commit: Commit, days: list[date], options: AggregateOptions) -> list[tuple[DataFrame, str, list]]:
        """Frames and the ranges each answers for: hours where they fit, minutes and seconds at
        their ends, raw rows in the partial seconds. Days whose coarse counters do not hold are
        read by second."""
        wide = [name for name, width in COARSE_TABLES.items() if BUCKET_SECONDS[options.bucket] % width == 0]
        raw, seconds, *coarse = split_range(options.since, options.until, [1, *[COARSE_TABLES[name] for name in wide]])
        covered = commit.coarse_days(days)
        found, missing = [], sorted(set(days) - set(covered))
        for name, ranges in zip(wide, coarse):
            kept = [day for day in covered if _touches(day, ranges)]
            if kept:
                found.append((self._visible(name, commit, kept), "bucket_start", ranges))
        within = [r for ranges in coarse for r in ranges]
        late = [day for day in missing if _touches(day, within)]
        if late:
            found.append((self._visible("log_rollup_1s", commit, late), "bucket_start", within))
        for name, ts, ranges in (("log_rollup_1s", "bucket_start", seconds), ("logs", "timestamp", raw)):
            touched = [day for day in days if _touches(day, ranges)]
            if touched:
                found.append((self._visible(name, commit, touched), ts, ranges))
        return found or [(self._visible("logs", commit, []), "timestamp", [(options.since, options.until)])]

    @staticmethod
    def _counters_pay(commit: Commit, days: list[date], bucket: str) -> bool:
        """Whether counters are so much fewer than rows that they make up for the scans beside them."""
        held = commit.size(days)
        if held is None:
            return True
        covered = commit.coarse_days(days)
        kind = "hours" if BUCKET_SECONDS[bucket] % COARSE_TABLES["log_rollup_1h"] == 0 else "minutes"
        counters = held[1] - commit.size(covered)[1] + sum(commit.coarse[day.isoformat()][kind] for day in covered)
        return counters + JOB_ROWS < held[0]

    # -- writing ------------------------------------------------------------

    def append(self, requests: DataFrame, source: str | None = None, version: int | None = None) -> Commit:
        """Validate a batch of (request_id, body, received_at) and store it.

        Logs, counters and responses become visible together. A (source, version)
        pair already committed is skipped, so a replayed batch changes nothing.
        received_at comes with the data: the time check then gives the same
        verdict on a replay. Every attempt leaves a row in `attempts`.
        """
        started, known = datetime.now(timezone.utc), {"source": source, "version": version}
        try:
            commit, size = self._append(requests, source, version)
        except Exception as failure:
            self._note(started, known | {"outcome": "failed", "error": f"{type(failure).__name__}: {failure}"[:500]})
            raise
        self._note(started, known | ({"outcome": "committed", **size} if size else {"outcome": "replayed"}))
        return commit

    def _note(self, started: datetime, row: dict) -> None:
        """One small file per attempt, under its day; one that cannot be written is no reason to fail."""
        seconds = (datetime.now(timezone.utc) - started).total_seconds()
        text = json.dumps({**row, "started": started.isoformat(), "seconds": seconds})
        folder = f"{self.root}/attempts/day={utc_date(started)}"
        try:
            paths.publish(self.spark, folder, f"{started:%H%M%S%f}-{uuid.uuid4().hex}.json", text)
        except (Py4JJavaError, OSError):
            pass

    def attempts(self) -> DataFrame:
        """Attempts to append, by METRICS_SCHEMA; see `operators.metrics.ingest_report`."""
        if not self.folders("attempts"):
            return self.spark.createDataFrame([], METRICS_SCHEMA)
        return self.spark.read.schema(METRICS_SCHEMA).json(f"{self.root}/attempts")

    def _append(self, requests: DataFrame, source: str | None, version: int | None) -> tuple[Commit, dict | None]:
        """The newest commit, and what this batch added to it; None if it was taken before."""

        def taken(commit: Commit) -> bool:
            return source is not None and version <= commit.sources.get(source, -1)

        last = self.last_commit()
        if taken(last):
            return last, None

        # Parsing is the costly step and three outputs need it, so its result is
        # written once. The row number is stored with it and stays what it is
        # when a task runs again: it counts from task << 33. Ids use the widest
        # task as stride: unique, rising with the position in a request, gaps allowed.
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        numbered = validate_requests(
            requests.selectExpr(
                "string(request_id) AS request_id",
                "body",
                "coalesce(received_at, raise_error('received_at must not be null')) AS received_at",
            )
        ).withColumn("row_number", F.monotonically_increasing_id())
        task, row = F.shiftright("row_number", 33), F.col("row_number").bitwiseAND((1 << 33) - 1)
        seen = Observation()
        observed = numbered.observe(
            seen,
            F.coalesce(F.max(task) + 1, F.lit(0)).alias("tasks"),
            F.coalesce(F.max(row) + 1, F.lit(0)).alias("stride"),
            F.count_if(F.col("timestamp").isNotNull()).alias("accepted"),
            F.count_if(F.col("reason").isNotNull()).alias("rejected"),
            # The other columns of a rejected entry are null, and so is its size.
            *[
                F.coalesce(F.sum(F.expr(e)), F.lit(0)).alias(n)
                for n, e in {"logs": ROW_BYTES["logs"], "log_rollup_1s": COUNTER_BYTES, "responses": RESPONSE_BYTES}.items()
            ],
        )
        observed.write.parquet(staging)
        size = seen.get
        staged = self.spark.read.schema(numbered.schema).parquet(staging)
        batch_id, first_id = self.reserve(size["tasks"] * size["stride"])
        accepted = staged.where(F.col("timestamp").isNotNull()).withColumn("day", F.to_date("timestamp"))
        outputs = {
            "logs": accepted.withColumn("id", F.lit(first_id) + task * size["stride"] + row),
            "log_rollup_1s": rollup_1s(accepted, "day"),
            "responses": summarise_requests(staged, "request_number").withColumn("day", F.to_date("received_at")),
        }

        def put(name: str, rows: DataFrame) -> dict[str, list[int]]:
            self._sizes[name, batch_id] = size[name]
            try:
                self.write(name, rows, batch_id)
            finally:
                del self._sizes[name, batch_id]
            return self.day_stats(batch_id) if name == "log_rollup_1s" and last.stats is not None else {}

        # Independent jobs: the small ones fill executors the large one leaves idle.
        stats: dict[str, list[int]] = {}
        with ThreadPoolExecutor(len(outputs)) as pool:
            write = inheritable_thread_target(self.spark)(put)
            for done in [pool.submit(write, name, rows) for name, rows in outputs.items()]:
                stats |= done.result()

        def add(state: Commit) -> Commit | None:
            if taken(state):
                return None
            return replace(
                state.with_batch(batch_id).with_stats(stats),
                sources=state.sources if source is None else {**state.sources, source: version},
                accepted=state.accepted + size["accepted"],
                rejected=state.rejected + size["rejected"],
            )

        commit = self.commit(add)
        paths.remove(self.spark, staging)
        if commit is None:
            return self.last_commit(), None
        return commit, {"batch_id": batch_id, "accepted": size["accepted"], "rejected": size["rejected"]}

    def day_stats(self, batch_id: int) -> dict[str, list[int]]:
        """Log rows and counter rows of each day of one batch, by its counters."""
        return self.counted(self.batch("log_rollup_1s", batch_id))

    def batch(self, table: str, batch_id: int) -> DataFrame:
        """Rows of one batch, visible or not."""
        days = [day for day in self.folders(table) if batch_id in self.batches(table, day)]
        if not days:
            return self.spark.createDataFrame([], SCHEMAS[table])
        reader = self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.root}/{table}")
        return reader.parquet(*[f"{self.root}/{table}/day={day}/batch_id={batch_id}" for day in days])

    @staticmethod
    def counted(rollup: DataFrame) -> dict[str, list[int]]:
        """Log rows and counter rows per day, one driver row a day."""
        by_day = rollup.groupBy("day").agg(F.sum("count").alias("rows"), F.count("*").alias("counters"))
        return {row["day"].isoformat(): [row["rows"], row["counters"]] for row in by_day.collect()}

    def batches(self, table: str, day: date) -> list[int]:
        """Batches that have a folder for the day, visible or not."""
        return sorted(map(int, paths.partition_values(self.spark, f"{self.root}/{table}/day={day}", "batch_id")))

    def live_batches(self, table: str, day: date, commit: Commit) -> list[int]:
        """Of them, those whose rows readers of this commit see."""
        name = day.isoformat()
        known = (b for b in self.batches(table, day) if b <= commit.batch_id and b not in commit.missing)
        return [b for b in known if not commit.replaced(table, name, b)]

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Rows are dealt out by day and hour and sorted within, so that file statistics
        prune time ranges. Adaptive execution merges small hours and splits an hour,
        or a single second, that holds most rows; it goes by compressed bytes. Where rows
        take more than TASK_BYTES to sort, they are dealt out in that order by their number
        instead, equal ones by their request's number or all their values. What they take is
        counted, unless it is known."""
        keys, columns = SORT_KEYS[name], StructType.fromDDL(SCHEMAS[name]).names
        size = self._sizes.get((name, batch_id))
        if size is None:
            size = rows.agg(F.sum(F.expr(ROW_BYTES[name]))).first()[0] or 0
        if name == "responses" and "request_number" in rows.columns:
            tie = F.col("request_number")
        else:
            tie = F.xxhash64(*[c for c in rows.columns if not c.startswith("attr_")])
        rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).select(
            *columns, F.date_trunc("hour", keys[0]).alias("_hour"), tie.alias("_tie")
        )
        tasks = -(-size // TASK_BYTES)
        if tasks > 1:
            rows = rows.repartitionByRange(tasks, "day", "_hour", "_tie")
        else:
            rows = rows.drop("_tie").hint("rebalance", "day", "_hour")
        rows = rows.sortWithinPartitions(*PARTITION_COLUMNS, *keys).select(*columns)
        # This mode replaces the partitions written and no others, here none, as the batch number is
        # new. Unlike plain appends it keeps a job's files apart from those of other writers.
        output = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        output.partitionBy(*PARTITION_COLUMNS).parquet(f"{self.root}/{name}")
