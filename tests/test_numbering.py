"""Consecutive numbers over range-sorted partitions."""

import random

from pyspark.sql import functions as F

from emberlog.operators.numbering import numbered


def test_numbers_follow_the_order_across_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), None if rng.random() < 0.1 else rng.choice("abc")) for _ in range(5000)]
    frame = spark.createDataFrame(rows, "a INT, b STRING").repartition(7)
    found = numbered(frame, "a", F.desc_nulls_last("b"), column="place").orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(5000))
    want = sorted(rows, key=lambda r: (r[0], r[1] is None, -ord(r[1] or "a")))
    assert [(r["a"], r["b"]) for r in found] == want


def test_equal_rows_spread_and_get_numbers_of_their_own(spark):
    frame = spark.range(0, 20_000, numPartitions=8).select(F.lit(1).alias("x"))
    found = numbered(frame, "x")
    assert found.agg(F.countDistinct("n"), F.min("n"), F.max("n")).first()[:] == (20_000, 0, 19_999)


def test_empty_frame(spark):
    assert numbered(spark.createDataFrame([], "x INT"), "x").collect() == []
