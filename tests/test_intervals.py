"""Interval joins against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import intervals
from quarryline.operators.intervals import Range, join_points


@pytest.mark.parametrize("kind,spread", [("int", 40), ("long", 2**40), ("double", 9)])
def test_pairs_equal_brute_force(spark, kind, spread):
    rng = random.Random(spread)
    value = lambda: None if rng.random() < 0.05 else rng.choice([rng.uniform(-spread, spread), rng.randint(-9, 9)]) if kind == "double" else rng.randint(-spread, spread)
    number = lambda x: None if x is None else float(x) if kind == "double" else x
    a = [(i, *(number(value()) for _ in range(4))) for i in range(150)]
    a += [(200, number(0), number(0), number(-spread), number(spread)), (201, number(3), number(2), number(0), number(1))]
    b = [(i, number(value()), number(value())) for i in range(150)] + [(300, number(0), number(0))]
    left = spark.createDataFrame(a, f"a long, l1 {kind}, h1 {kind}, l2 {kind}, h2 {kind}")
    right = spark.createDataFrame(b, f"b long, x {kind}, y {kind}")
    ranges = [Range(F.col("l1"), F.col("h1"), F.col("x")), Range(F.col("l2"), F.col("h2"), F.col("y"))]
    within = lambda lo, v, hi: None not in (lo, v, hi) and lo <= v <= hi
    for n in (1, 2):
        got = sorted((r.a, r.b) for r in join_points(left, right, ranges[:n]).select("a", "b").collect())
        assert got == sorted((i[0], p[0]) for i in a for p in b if within(i[1], p[1], i[2]) and (n == 1 or within(i[3], p[2], i[4])))


def test_no_pair_is_compared_by_a_nested_loop(spark):
    left = spark.createDataFrame([(1, 2, 3)], "a long, l int, h int")
    right = spark.createDataFrame([(1, 2)], "b long, x int")
    found = join_points(left, right, [Range(F.col("l"), F.col("h"), F.col("x"))])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert join_points(left.limit(0), right, [Range(F.col("l"), F.col("h"), F.col("x"))]).count() == 0
    assert found.columns == ["a", "l", "h", "b", "x"]


def test_parts_of_large_bins_have_each_pair_once(spark, monkeypatch):
    for name, n in (("PART_ROWS", 16), ("PART_PAIRS", 64), ("TASK_ROWS", 64)):
        monkeypatch.setattr(intervals, name, n)
    rng = random.Random(7)
    spans = [(i, (low := rng.randint(0, 30)), low + 10, rng.randint(0, 3), 9) for i in range(200)] + [(300, 5, 15, 0, 9)] * 3 + [(301, 70, 80, 0, 9)] * 40
    places = [(i, rng.randint(0, 40), rng.choice([None, 1, 5, 9])) for i in range(60)] + [(100, 12, 5)] * 2 + [(101, -90, 5)] * 40
    left = spark.createDataFrame(spans, "a long, l1 int, h1 int, l2 int, h2 int").withColumn("m", F.create_map(F.lit("a"), "a"))
    right = spark.createDataFrame(places, "b long, x int, y int")
    found = join_points(left, right, [Range(F.col("l1"), F.col("h1"), F.col("x")), Range(F.col("l2"), F.col("h2"), F.col("y"))])
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((s[0], p[0]) for s in spans for p in places if p[2] is not None and s[1] <= p[1] <= s[2] and s[3] <= p[2] <= s[4])
    assert found.columns == ["a", "l1", "h1", "l2", "h2", "m", "b", "x", "y"]


@pytest.mark.parametrize("many", ["intervals", "points"])
def test_rows_of_one_bin_go_to_many_tasks(spark, many):
    n = {"intervals": (600_000, 4), "points": (4, 600_000)}[many]
    left = spark.range(n[0]).select(F.col("id").alias("a"), (F.col("id") % 4).alias("l"), (F.col("id") % 4 + 10).alias("h"))
    right = spark.range(n[1]).select(F.col("id").alias("b"), (F.col("id") % 4 + 3).alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = join_points(left, right, [Range(F.col("l"), F.col("h"), F.col("x"))])
        by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(by_task) == 2_400_000 and max(by_task) < 0.6 * sum(by_task)
