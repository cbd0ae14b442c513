"""Filters over the messages and attributes of stored files."""

import random
from dataclasses import replace
from datetime import date

import pytest
from helpers import batch, good, requests, utc
from pyspark.sql import functions as F

from emberlog import AttrFilter, LogStore, SearchOptions
from emberlog.functions.text import contains_pattern, literal_parts
from emberlog.operators.maintenance import build_filters, compact, drop_expired, run_maintenance
from emberlog.operators.search import matching_logs
from emberlog.operators.terms import SLICE_BITS, _spread, asked_terms, files_without


WORDS = ["Zug", "ΟΔΟΣ", "Σίσυφος", "İstanbul", "100%", "a_b", "back\\slash", "naïve", "x", "", "日本語のログ", "😀😀😀", "TIMEOUT"]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """Five days of odd messages and attributes; the last day's files have no filters."""
    store, pick = LogStore(spark, str(tmp_path_factory.mktemp("filters") / "store")), random.Random(5)
    for day in range(1, 6):
        rows = [
            good(timestamp=f"2026-02-0{day}T10:00:00Z", message=f"m {' '.join(pick.choices(WORDS, k=3))}", attributes={"n": n % 3 + day, "d": str(day)})
            for n in range(12)
        ]
        store.append(requests(spark, batch(*rows), received="2026-12-31T00:00:00Z"))
    assert len(build_filters(store, date(2026, 2, 5))) == 4
    return store


def test_parts_of_patterns():
    assert literal_parts(contains_pattern("a%bc_d")) == ["a", "bc", "d"]
    assert literal_parts(contains_pattern(r"5\%\_x")) == ["5%_x"]
    assert literal_parts(contains_pattern("100%_\\", literal=True)) == ["100%_\\"]
    assert literal_parts("%%") == []


def test_filtered_searches_equal_the_scan(filled):
    """Random pieces of messages with wildcards, in any case, and attributes, present and not."""
    pick, logs = random.Random(9), filled.logs()
    texts = [row["message"] for row in logs.collect()]
    for _ in range(25):
        text = pick.choice(texts)
        start = pick.randrange(len(text))
        q = list(text[start : start + pick.randint(1, 9)])
        q[pick.randrange(len(q))] = pick.choice(["_", "%", q[0]])
        q = pick.choice([str.upper, str.lower, str])("".join(q))
        attrs = pick.choice([(), (AttrFilter("n", str(pick.randint(1, 9))),), (AttrFilter("d", "2"), AttrFilter("n", "3"))])
        options = SearchOptions(q=q, attrs=attrs, limit=None, literal_q=pick.random() < 0.3)
        found = sorted(row["id"] for row in filled.search(options, use_filters=True).collect())
        assert found == sorted(row["id"] for row in matching_logs(logs, options).collect()), options


def test_files_are_left_out(filled):
    days = filled.days("logs")

    def left_out(**asked):
        return {name.split("/")[0][-1] for name in filled.files_without_match(days, SearchOptions(**asked))}

    assert left_out(attrs=(AttrFilter("d", "3"),)) == {"1", "2", "4"}
    assert left_out(attrs=(AttrFilter("d", "9"),)) == {"1", "2", "3", "4"}  # the fifth has no filters
    assert left_out(q="no such text") == {"1", "2", "3", "4"}
    assert left_out(q="m ") == left_out(q="%") == left_out() == set()
    scan = filled.search(SearchOptions(attrs=(AttrFilter("d", "3"),), limit=None), use_filters=True)
    assert scan.count() == 12
    assert {row[0] for row in scan.select(F.dayofmonth("timestamp")).distinct().collect()} == {3}


def test_false_positives_are_rare(spark):
    """50,000 terms in a filter: few of 10,000 others pass."""
    slices = 32  # a power of two that gives each term 16 bits at least
    hashes = spark.range(50_000).select(F.explode(_spread(F.xxhash64("id"))).alias("h"))
    at = F.pmod("h", F.lit(slices * SLICE_BITS))
    made = hashes.groupBy(F.floor(at / SLICE_BITS).alias("slice")).agg(F.bitmap_construct_agg(at % SLICE_BITS).alias("bits"))
    made = made.select("slice", "bits", F.lit(slices).cast("bigint").alias("slices"), F.lit("attribute").alias("kind"), F.lit("f").alias("file")).cache()
    inside = [row[0] for row in spark.range(0, 50_000, 500).select(_spread(F.xxhash64("id"))).collect()]
    outside = [row[0] for row in spark.range(10**6, 10**6 + 300).select(_spread(F.xxhash64("id"))).collect()]
    assert files_without(made, {"attribute": sum(inside, [])}).count() == 0
    passed = 0
    for places in outside[:40]:
        passed += files_without(made, {"attribute": places}).count() == 0
    assert passed <= 3


def test_nothing_is_asked_of_short_texts(spark):
    assert asked_terms(spark, SearchOptions(q="ab%cd_e")) == {}
    assert len(asked_terms(spark, SearchOptions(q="abcd", attrs=(AttrFilter("k", "v"),)))["message"]) == 6


def test_filters_follow_rewrites_and_retention(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    for n in range(2):
        store.append(requests(spark, batch(*[good(timestamp=f"2026-02-0{d}T10:00:00Z", attributes={"n": n}) for d in (1, 2)]), received="2026-12-31T00:00:00Z"))
    assert run_maintenance(store, utc(2026, 2, 2), 30)["filters"] == [date(2026, 2, 1)]
    assert build_filters(store, date(2026, 2, 2)) == []
    assert compact(store, "logs", date(2026, 2, 3)) == [date(2026, 2, 2)]
    assert build_filters(store, date(2026, 2, 3)) == [date(2026, 2, 2)]
    build_filters(store, date(2026, 2, 3))
    for day in store.days("logs"):
        assert store.batches("log_filters", day) == store.live_batches("logs", day, store.last_commit())
    rare = SearchOptions(attrs=(AttrFilter("n", "1"),), limit=None)
    assert store.search(rare, use_filters=True).count() == store.search(replace(rare, limit=10), use_filters=True).count() == 2
    drop_expired(store, utc(2026, 2, 9), 7)
    drop_expired(store, utc(2026, 2, 9), 7)
    assert store.folders("log_filters") == store.folders("logs") == [date(2026, 2, 2)]
    assert store.search(rare, use_filters=True).count() == 1
