"""Joins of intervals and points by equal bins, with an exact filter.

An interval of a length below 2^k has level k and lies in at most two bins of width 2^k;
a point lies in one bin of each level. So an interval has at most two rows (for each
dimension, multiplied), a point one for each level that an interval has, and the pairs that meet in a
bin are few more than those that match: an interval fills at least a quarter of its two bins.

Where intervals are long against the span of the data, there are few bins and each grows with the input.
So bins are counted first, and a large one is dealt: its intervals to some parts, its points to others, and
each part of the one meets each part of the other apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows a side and pairs that may meet in one part of a bin, and rows that a task has of each side on average.
PART_ROWS, PART_PAIRS, TASK_ROWS = 1 << 16, 1 << 20, 1 << 18
# More tasks than that are not made for the sake of pairs alone.
MOST_TASKS = 10_000


class Range(NamedTuple):
    """low <= point <= high: two expressions over the intervals' columns, one over the points'. Nulls match nothing."""

    low: Column
    high: Column
    point: Column


def _whole(c: Column) -> Column:
    """Rises with c; far values are clamped, so that lengths fit a long. Bins are only to bring pairs together."""
    return F.greatest(F.least(F.floor(c.cast("double")).cast("long"), F.lit(1 << 61)), F.lit(-(1 << 61)))


def _level(low: Column, high: Column) -> Column:
    """The bits of the length; 0 for a single place."""
    return F.when(high == low, 0).otherwise(F.length(F.bin(high - low)))


def _parts(n: int, m: int) -> tuple[int, int]:
    """Into how many parts n intervals and m points of one bin are dealt, with the fewest copies: a row is copied for each part of the other side."""
    own, other = max(1, math.ceil(n / PART_ROWS)), max(1, math.ceil(m / PART_ROWS))
    if n and m:
        cells = math.ceil(n * m / PART_PAIRS)
        own = max(own, min(cells, math.ceil(math.sqrt(cells * n / m))))
        other = max(other, math.ceil(cells / own))
    return own, other


def _large_bins(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[list[tuple], int]:
    """The keys of bins too large for one part with their numbers of parts (interval parts, point parts), and the number of tasks that all bins need.

    Only these bins come to the driver: each has thousands of rows.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bins = left.select(*keys, one.alias("n"), none.alias("m")).unionAll(right.select(*keys, none.alias("n"), one.alias("m"))).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    pairs = F.col("n").cast("double") * F.col("m")
    large = F.when((F.greatest("n", "m") > PART_ROWS) | (pairs > PART_PAIRS), F.struct(*keys, "n", "m"))
    total = bins.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(pairs).alias("pairs"), F.collect_list(large).alias("large")).first()
    intervals, points, found = total["n"] or 0, total["m"] or 0, []
    for *key, n, m in total["large"]:
        own, other = _parts(n, m)
        found.append((*key, own, other))
        intervals, points = intervals + n * (other - 1), points + m * (own - 1)
    return found, max(math.ceil(max(intervals, points) / TASK_ROWS), min(MOST_TASKS, math.ceil((total["pairs"] or 0) / PART_PAIRS)))


def _dealt(df: DataFrame, parts: DataFrame, keys: Sequence[str], own: str, other: str) -> DataFrame:
    """Rows with the number of their part (own), once for each part of the other side. Equal rows go to one part, so that a task that runs again deals alike."""
    row = F.xxhash64(*(F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind))
    found = df.join(F.broadcast(parts), list(keys), "left")
    of, copies = F.coalesce(f"{own}s", F.lit(1)), F.coalesce(f"{other}s", F.lit(1))
    dealt = found.withColumn(own, F.when(of > 1, F.pmod(row, of)).otherwise(0).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), copies - 1))).drop(f"{own}s", f"{other}s")


def join_points(intervals: DataFrame, points: DataFrame, ranges: Sequence[Range]) -> DataFrame:
    """All pairs of an interval and a point that lies in it in every dimension; columns of both, which must not clash.

    The levels that occur (at most 64 in a dimension) and the rows of each bin are counted first. A task's rows do not
    grow with the input: with more rows there are more tasks.
    """
    left = intervals
    for k, r in enumerate(ranges):
        left = left.withColumns({f"_low{k}": r.low, f"_high{k}": r.high}).where(F.col(f"_low{k}") <= F.col(f"_high{k}"))
        low, high = _whole(F.col(f"_low{k}")), _whole(F.col(f"_high{k}"))
        left = left.withColumn(f"_level{k}", _level(low, high))
    right = points
    levels = left.agg(*(F.collect_set(f"_level{k}") for k in range(len(ranges)))).first()
    for k, r in enumerate(ranges):
        right = right.withColumn(f"_point{k}", r.point).where(F.col(f"_point{k}").isNotNull())
        right = right.withColumn(f"_level{k}", F.explode(F.array(*map(F.lit, sorted(levels[k]) or [0]))))
        # A shift by a column's value: the width is a power of two.
        bin_of = lambda c, k=k: F.floor(_whole(c) / F.pow(F.lit(2.0), F.col(f"_level{k}"))).cast("long")
        right = right.withColumn(f"_bin{k}", bin_of(F.col(f"_point{k}")))
        left = left.withColumn(f"_bin{k}", F.explode(F.array_distinct(F.array(bin_of(F.col(f"_low{k}")), bin_of(F.col(f"_high{k}"))))))
    keys = [f"_{name}{k}" for k in range(len(ranges)) for name in ("level", "bin")]
    left, right = left.drop(*(f"_{end}{k}" for k in range(len(ranges)) for end in ("low", "high"))), right.drop(*(f"_point{k}" for k in range(len(ranges))))
    large, tasks = _large_bins(left, right, keys)
    if tasks > 1:
        spark = left.sparkSession
        parts = spark.createDataFrame(large, ", ".join([*(f"{key} {left.schema[key].dataType.simpleString()}" for key in keys), "_parts int", "_point_parts int"]))
        left, right = _dealt(left, parts, keys, "_part", "_point_part"), _dealt(right, parts, keys, "_point_part", "_part")
        keys += ["_part", "_point_part"]
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    met = left.join(right, keys).drop(*keys)
    return reduce(lambda df, r: df.where((r.low <= r.point) & (r.point <= r.high)), ranges, met)
