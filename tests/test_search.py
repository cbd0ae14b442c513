import random
from dataclasses import replace
from datetime import datetime

import pytest
from helpers import logs, utc
from pyspark.sql import functions as F

from emberlog import AttrFilter, Cursor, SearchOptions, search_logs, search_page
from emberlog.functions.text import contains_pattern
from emberlog.operators.rollup import rollup_1s
from emberlog.operators.search import iterate_pages, newest_from_counters, rendered_logs


def messages(spark, texts):
    return logs(spark, [(n, datetime(2024, 1, 1), "info", "s", t, "{}") for n, t in enumerate(texts)])


TEXTS = ["axb", "a%b", "A_B", "a\\b", "ab", "foo%", "foo\\", "FOO", "a.b", "quib"]


@pytest.mark.parametrize(
    "q,literal,expected",
    [
        ("a%b", False, {"axb", "a%b", "A_B", "a\\b", "ab", "a.b"}),
        ("a\\%b", False, {"a%b"}),
        ("a_b", False, {"axb", "a%b", "A_B", "a\\b", "a.b"}),
        ("a\\_b", False, {"A_B"}),
        ("a\\\\b", False, {"a\\b"}),
        ("\\b", False, {"axb", "a%b", "A_B", "a\\b", "ab", "a.b", "quib"}),
        ("foo\\", False, {"foo%"}),
        ("foo\\\\", False, {"foo\\"}),
        ("FOO", False, {"foo%", "foo\\", "FOO"}),
        ("a.b", False, {"a.b"}),
        ("a%b", True, {"a%b"}),
        ("a_b", True, {"A_B"}),
        ("foo\\", True, {"foo\\"}),
    ],
)
def test_message_filter(spark, q, literal, expected):
    found = search_logs(messages(spark, TEXTS), SearchOptions(q=q, literal_q=literal)).collect()
    assert {r["message"] for r in found} == expected


def test_plain_text_becomes_a_contains(spark):
    frame = messages(spark, TEXTS).where(F.col("message").ilike(contains_pattern("PURCHASE")))
    assert "Contains(lower(message" in frame._jdf.queryExecution().optimizedPlan().toString()


def attributes(spark, texts):
    return logs(spark, [(n, datetime(2024, 1, 1), "info", "s", "m", t) for n, t in enumerate(texts)])


@pytest.mark.parametrize(
    "key,value,expected",
    [
        ("user.id", "42", [1]),
        ("user", '{"id":"42"}', [0]),
        ("id", "42", []),
        ("k", "3", [2, 3]),
        ("k", "true", [4]),
        ("k", "null", []),
        ("k", "0.0005", [6]),
        ("k", "1000000000000000000000", [7]),
        ("gone", "", []),
        ("k", "", [8]),
        ("k", "100", [10]),
        ("k", "1.5", [11]),
        (".", "x", [12]),
        ("0", "y", [12]),
        ("k", "é\"", [13]),
    ],
)
def test_attribute_filter(spark, key, value, expected):
    texts = [
        '{"user":{"id":"42"}}', '{"user.id":42}', '{"k":3}', '{"k":"3"}', '{"k":true}', '{"k":null}',
        '{"k":0.0005}', '{"k":1000000000000000000000}', '{"k":""}', "{}", '{"k":1E2}', '{"k":1.50}', '{".":"x","0":"y"}', '{"k":"\\u00e9\\""}',
    ]
    found = search_logs(attributes(spark, texts), SearchOptions(attrs=(AttrFilter(key, value),))).collect()
    assert sorted(r["id"] for r in found) == expected


def test_filters_are_anded_and_ranges_half_open(spark):
    rows = [
        (n, datetime(2024, 1, 1, 0, 0, n), level, service, "Hello", '{"a":"1","b":2}')
        for n, (level, service) in enumerate([("info", "x"), ("info", "x"), ("warn", "x"), ("info", "X")])
    ]
    frame = logs(spark, rows)
    options = SearchOptions(
        service="x", level="info", since=utc(2024, 1, 1), until=utc(2024, 1, 1, 0, 0, 1), q="hell",
        attrs=(AttrFilter("a", "1"), AttrFilter("b", "2")),
    )
    assert [r["id"] for r in search_logs(frame, options).collect()] == [0]
    assert [r["id"] for r in search_logs(frame, SearchOptions(service="X")).collect()] == [3]
    assert search_logs(frame, replace(options, until=options.since)).count() == 0


def tied(spark, rng, count=200):
    rows = [
        (n, datetime(2024, 1, 1, 0, 0, rng.randrange(9), rng.randrange(2)), "info", rng.choice("ab"), "m", "{}")
        for n in range(count)
    ]
    return rows, logs(spark, rows)


def test_pages_rebuild_the_whole_order(spark):
    rows, frame = tied(spark, random.Random(1))
    expected = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True) if r[3] == "a"]
    pages = list(iterate_pages(frame, SearchOptions(service="a", limit=17)))
    assert [row["id"] for page in pages for row in page.rows] == expected
    assert all(len(page.rows) == 17 for page in pages[:-1])
    assert pages[-1].next_cursor is None and all(p.next_cursor for p in pages[:-1])


def test_page_is_trimmed_and_anchored_on_its_last_row(spark):
    frame = logs(spark, [(n, datetime(2024, 1, 1, 0, 0, 0, n), "info", "s", "m", "{}") for n in (7, 8, 9, 10)])
    page = search_page(frame, SearchOptions(limit=3))
    assert [r["id"] for r in page.rows] == [10, 9, 8]
    assert page.rows[0].asDict().keys() == {"id", "timestamp", "level", "service", "message", "attributes"}
    assert page.next_cursor == Cursor(utc(2024, 1, 1, 0, 0, 0, 8), 8).encode()
    assert search_page(frame, SearchOptions(limit=4)).next_cursor is None


def test_top_k_plan(spark, tmp_path):
    rows, frame = tied(spark, random.Random(2))
    frame.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    options = SearchOptions(cursor=Cursor(utc(2024, 1, 1, 0, 0, 5), 50), since=utc(2024, 1, 1), limit=5)
    plan = search_logs(stored, options)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "LessThanOrEqual(timestamp" in plan and "GreaterThanOrEqual(timestamp" in plan


def test_counters_bound_the_newest_rows(spark):
    rng = random.Random(3)
    rows, frame = tied(spark, rng, 300)
    rollup = rollup_1s(frame)
    for _ in range(12):
        options = SearchOptions(
            service=rng.choice([None, "a"]),
            since=rng.choice([None, utc(2024, 1, 1, 0, 0, 1, 1)]),
            until=rng.choice([None, utc(2024, 1, 1, 0, 0, 7, 1)]),
            cursor=rng.choice([None, Cursor(utc(2024, 1, 1, 0, 0, 6, 1), 100)]),
            limit=rng.choice([1, 3, 5]),
        )
        found, bound = newest_from_counters(rollup, options, options.limit)
        full = search_logs(frame, options).collect()
        if found == options.limit:
            since = max(m for m in (bound, options.since) if m)
            assert search_logs(frame, replace(options, since=since)).collect() == full
    assert newest_from_counters(rollup, SearchOptions(q="m"), 1) == (0, None)
    assert newest_from_counters(rollup, SearchOptions(service="none"), 1) == (0, None)
    assert newest_from_counters(rollup, SearchOptions(), 10_000)[0] == rollup.count()


def test_rendering(spark):
    frame = logs(spark, [(5, datetime(2024, 1, 2, 3, 4, 5, 678901), "info", "s", "m", '{"a":1}')])
    (row,) = rendered_logs(frame).collect()
    assert tuple(row) == ("5", "2024-01-02T03:04:05.678Z", "info", "s", "m", '{"a":1}')


def test_the_last_of_repeated_attribute_keys_counts(spark):
    frame = logs(spark, [(1, datetime(2024, 1, 1), "info", "a", "m", '{"k":"a","k":"b"}'), (2, datetime(2024, 1, 1), "info", "a", "m", '{"k":1,"k":2}')])
    for value, ids in (("a", []), ("b", [1]), ("1", []), ("2", [2])):
        found = search_logs(frame, SearchOptions(attrs=(AttrFilter("k", value),))).collect()
        assert [r["id"] for r in found] == ids
