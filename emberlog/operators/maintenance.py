"""Retention, compaction and the job that runs both."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.timestamps import utc_date
from emberlog.operators.rollup import coarser, merge_deltas, rollup_1s
from emberlog.schema import COARSE_TABLES, DEFAULT_RETENTION_DAYS, TABLE_SCHEMAS
from emberlog.sources import paths
from emberlog.sources.store import Commit, LogStore


def partition_name(day: date) -> str:
    return f"logs_y{day.year:04d}m{day.month:02d}d{day.day:02d}"


def partition_name_column(day: Column) -> Column:
    return F.concat(F.lit("logs_"), F.date_format(day, "'y'yyyy'm'MM'd'dd"))


def cutoff_day(now: datetime, retention_days: int = DEFAULT_RETENTION_DAYS) -> date:
    """First UTC day that is kept."""
    return utc_date(now - timedelta(days=retention_days))


def drop_expired(
    store: LogStore, now: datetime, retention_days: int = DEFAULT_RETENTION_DAYS
) -> list[str]:
    """Take whole days before the cutoff out of every table; counters go with the rows
    they count. Returns the names of the dropped log partitions, ascending.

    The cutoff is recorded, and new readers keep to it. Folders go one run later,
    for queries that are still reading them.
    """
    cutoff, last = cutoff_day(now, retention_days), store.last_commit()
    if last.cutoff is not None:
        for table in (*TABLE_SCHEMAS, *COARSE_TABLES, "log_filters"):
            for day in store.folders(table):
                if day.isoformat() < last.cutoff:
                    paths.remove(store.spark, f"{store.root}/{table}/day={day}")
    # Attempts are kept as long as rows, by the day they were made.
    for day in store.folders("attempts"):
        if day < cutoff:
            paths.remove(store.spark, f"{store.root}/attempts/day={day}")
    expired = [day for day in store.days("logs", last) if day < cutoff]
    if any(day < cutoff for table in TABLE_SCHEMAS for day in store.days(table, last)):
        def cut(state: Commit) -> Commit:
            first = max(state.cutoff or "", cutoff.isoformat())
            kept = state.stats and {day: size for day, size in state.stats.items() if day >= first}
            coarse = {day: entry for day, entry in state.coarse.items() if day >= first}
            return replace(state, cutoff=first, stats=kept, coarse=coarse)

        store.commit(cut)
    return [partition_name(day) for day in expired]


def compact(store: LogStore, table: str, before: date) -> list[date]:
    """Rewrite each earlier day that holds several batches as one.

    Counters become one row per (second, service, level); other tables fewer, larger
    files. The rewrite is a batch of its own, and readers switch to it when its
    commit record appears; batches that others commit meanwhile stay as they are.
    The files it replaces stay until the next run, for queries that are still
    reading them. A day that another run has rewritten meanwhile is left to it.
    """
    spark, last = store.spark, store.last_commit()
    for day in last.compacted.get(table, {}):
        for value in store.batches(table, date.fromisoformat(day)):
            if last.replaced(table, day, value):
                paths.remove(spark, f"{store.root}/{table}/day={day}/batch_id={value}")
    # Folder names say which days hold several batches; no row is read for it.
    days = [day for day in store.days(table, last) if day < before]
    crowded = [day for day in days if len(store.live_batches(table, day, last)) > 1]
    if not crowded:
        return []
    rows = store._visible(table, last, crowded)
    if table == "log_rollup_1s":
        rows = merge_deltas(rows, "day")
    batch_id, _ = store.reserve()
    store.write(table, rows, batch_id)
    fewer: dict[str, list[int]] = {}
    if table == "log_rollup_1s" and last.stats is not None:
        merged = store.day_stats(batch_id)
        fewer = {day: [0, size[1] - last.stats.get(day, [0, 0])[1]] for day, size in merged.items()}

    return crowded if _swap(store, table, last, crowded, batch_id, fewer) else []


def _swap(
    store: LogStore, table: str, last: Commit, days: list[date], batch_id: int, sizes: dict[str, list[int]], recount: bool = False
) -> bool:
    """Let readers see a batch in place of what these days held at `last`, unless another rewrite
    of one of them came first. `sizes` are added to those of the days; after a recount the minutes
    and hours of the days hold no more."""

    def swap(state: Commit) -> Commit | None:
        known, now = last.compacted.get(table, {}), state.compacted.get(table, {})
        if any(known.get(day.isoformat()) != now.get(day.isoformat()) for day in days):
            return None
        entry = {"upto": last.batch_id, "late": last.missing}
        live = {d: e for d, e in now.items() if state.cutoff is None or d >= state.cutoff}
        entries = {**live, **{day.isoformat(): entry for day in days}}
        gone = {day.isoformat() for day in days} if recount else set()
        coarse = {d: e for d, e in state.coarse.items() if d not in gone}
        return replace(state.with_batch(batch_id).with_stats(sizes), compacted={**state.compacted, table: entries}, coarse=coarse)

    return store.commit(swap) is not None


def damaged_days(store: LogStore, before: date, commit: Commit | None = None) -> list[date]:
    """Earlier days whose counters are not those of their log rows: too many, too few or of other
    seconds, services or levels. Both tables are read as of one commit."""
    last = commit or store.last_commit()
    days = [day for day in sorted({*store.days("logs", last), *store.days("log_rollup_1s", last)}) if day < before]
    counted = rollup_1s(store._visible("logs", last, days), "day")
    held = store._visible("log_rollup_1s", last, days).select(*counted.columns)
    both = counted.unionByName(held.withColumn("count", -F.col("count")))
    wrong = both.groupBy("day", "bucket_start", "service", "level").agg(F.sum("count").alias("off")).where("off <> 0")
    return sorted(row["day"] for row in wrong.select("day").distinct().collect())


def rebuild_counters(store: LogStore, before: date) -> list[date]:
    """Count the damaged ones of the earlier days anew from their log rows; gives the days mended.

    The new counters take the place of the old by one commit. Batches that others commit meanwhile
    bring their own, and a day that a compaction rewrites meanwhile is left to the next run. Minutes
    and hours of a mended day are built again by the next maintenance.
    """
    last = store.last_commit()
    days = damaged_days(store, before, last)
    if not days:
        return []
    batch_id, _ = store.reserve()
    store.write("log_rollup_1s", rollup_1s(store._visible("logs", last, days), "day"), batch_id)
    sizes: dict[str, list[int]] = {}
    if last.stats is not None:
        made = store.day_stats(batch_id)
        for day in map(date.isoformat, days):
            sizes[day] = [new - old for new, old in zip(made.get(day, [0, 0]), last.stats.get(day, [0, 0]))]
    return days if _swap(store, "log_rollup_1s", last, days, batch_id, sizes, recount=True) else []


def build_coarse(store: LogStore, before: date) -> list[date]:
    """Minutes and hours of each earlier day whose own do not hold its rows (any more).

    Seconds are read once; hours come from minutes. A day that grew meanwhile is left to the next
    run; files of minutes and hours that others replaced go one run later.
    """
    last = store.last_commit()
    if last.stats is None:
        return []
    for table in COARSE_TABLES:
        for day in store.days(table, last):
            kept = last.coarse.get(day.isoformat(), {}).get("batch")
            for value in store.batches(table, day):
                if kept is not None and value < kept:
                    paths.remove(store.spark, f"{store.root}/{table}/day={day}/batch_id={value}")
    days = [day for day in store.days("log_rollup_1s", last) if day < before and day.isoformat() in last.stats]
    days = sorted(set(days) - set(last.coarse_days(days)))
    if not days:
        return []
    batch_id, _ = store.reserve()
    counters, held = store._visible("log_rollup_1s", last, days), {}
    for table, width in COARSE_TABLES.items():
        store.write(table, coarser(counters, width, "day"), batch_id)
        counters = store.batch(table, batch_id)
        held[table] = store.counted(counters)

    def add(state: Commit) -> Commit:
        built = {}
        for day in map(date.isoformat, days):
            size = last.stats[day]
            if (state.stats or {}).get(day) == size and (state.cutoff is None or day >= state.cutoff):
                minutes, hours = (held[table].get(day, [0, 0])[1] for table in COARSE_TABLES)
                built[day] = {"batch": batch_id, "size": size, "minutes": minutes, "hours": hours}
        return replace(state.with_batch(batch_id), coarse={**state.coarse, **built})

    added = store.commit(add).coarse
    return [day for day in days if added.get(day.isoformat(), {}).get("batch") == batch_id]


def build_filters(store: LogStore, before: date) -> list[date]:
    """Filters over messages and attributes for the files of each earlier day that have none, and
    none any more for batches that a rewrite has replaced. A day's rows are read once for them."""
    last, missing = store.last_commit(), {}
    for day in (day for day in store.days("logs", last) if day < before):
        live, held = store.live_batches("logs", day, last), store.batches("log_filters", day)
        for value in held:
            if last.replaced("logs", day.isoformat(), value):
                paths.remove(store.spark, f"{store.root}/log_filters/day={day}/batch_id={value}")
        if set(live) - set(held):
            missing[day] = sorted(set(live) - set(held))
    if missing:
        store.write_filters(missing)
    return list(missing)


def count_days(store: LogStore) -> bool:
    """Give a store from before per-day statistics its own, by its counters. Left to the next run
    if others commit meanwhile."""
    last = store.last_commit()
    if last.stats is not None:
        return False
    stats = store.counted(store._visible("log_rollup_1s", last))
    return store.commit(lambda state: replace(state, stats=stats) if state.version == last.version else None) is not None


def run_maintenance(
    store: LogStore, now: datetime, retention_days: int = DEFAULT_RETENTION_DAYS
) -> dict[str, object]:
    """One pass, safe to repeat and to run beside ingestion. A failing step is reported
    and does not stop the next. Counters are merged up to today, the day most queries ask
    for; rows and responses of a day are rewritten once it is over."""
    today = utc_date(now)
    steps = {
        "counted": lambda: count_days(store),
        "dropped": lambda: drop_expired(store, now, retention_days),
        "compacted": lambda: compact(store, "log_rollup_1s", today + timedelta(days=1)),
        "coarse": lambda: build_coarse(store, today),
        "rewritten": lambda: compact(store, "logs", today),
        "filters": lambda: build_filters(store, today),
        "responses": lambda: compact(store, "responses", today),
    }
    report: dict[str, object] = {"errors": {}}
    for name, step in steps.items():
        try:
            report[name] = step()
        except Exception as failure:  # noqa: BLE001 - each step stands alone
            report["errors"][name] = failure
    return report
