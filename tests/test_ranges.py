"""Range joins against every pair."""

from __future__ import annotations

import datetime
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.operators import labels, ranges

DAY = datetime.date(1969, 12, 1)  # days before 1970 have negative numbers


def drawn(seed: int):
    rng = random.Random(seed)
    day = lambda k: None if k is None else DAY + datetime.timedelta(days=k)
    points = [(rng.choice("AB") if rng.random() > 0.02 else None, day(rng.choice([rng.randrange(200), rng.randrange(200), None]) if rng.random() < 0.1 else rng.randrange(200)), k) for k in range(300)]
    intervals = []
    for k in range(60):
        a = rng.randrange(200)
        intervals.append((rng.choice("AB"), day(a), day(a + rng.choice([-3, 0, 1, 5, 40])) if rng.random() > 0.05 else None, k))
    return points, intervals


@pytest.mark.parametrize("seed, width", [(0, 1), (1, 7), (2, 1000)])
def test_points_in_intervals(spark, seed, width):
    points, intervals = drawn(seed)
    p, i = spark.createDataFrame(points, "symbol string, date date, n int"), spark.createDataFrame(intervals, "symbol string, a date, b date, m int")
    pairs = Counter((n, m) for s, d, n in points for t, a, b, m in intervals if s is not None and s == t and d is not None and b is not None and a <= d <= b)
    join = lambda how: ranges.within(p, i, ["symbol"], "date", "a", "b", width, how)
    assert Counter((r.n, r.m) for r in join("inner").collect()) == pairs and join("inner").columns == ["symbol", "date", "n", "a", "b", "m"]
    hit = {n for n, _ in pairs}
    assert sorted(r.n for r in join("left_semi").collect()) == sorted(hit)
    assert sorted(r.n for r in join("left_anti").collect()) == sorted({n for *_, n in points} - hit)
    assert Counter((r.n, r.m) for r in join("left").collect()) == pairs + Counter((n, None) for *_, n in points if n not in hit)


@pytest.mark.parametrize("width", [1, 10, 500])
def test_overlapping_intervals(spark, width):
    _, a = drawn(5)
    _, b = drawn(6)
    left, right = spark.createDataFrame(a, "symbol string, a date, b date, n int"), spark.createDataFrame(b, "symbol string, c date, d date, m int")
    ok = lambda x: x[2] is not None and x[1] <= x[2]
    want = Counter((x[3], y[3]) for x in a for y in b if ok(x) and ok(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert Counter((r.n, r.m) for r in ranges.overlapping(left, right, ["symbol"], ("a", "b"), ("c", "d"), width).collect()) == want


def test_doubles_and_timestamps(spark):
    p = spark.createDataFrame([("A", 0.5), ("A", 1.0), ("A", -2.5)], "k string, x double")
    i = spark.createDataFrame([("A", 0.5, 0.9), ("A", -3.0, 1.0)], "k string, lo double, hi double")
    assert sorted((r.x, r.lo) for r in ranges.within(p, i, ["k"], "x", "lo", "hi", 0.25).collect()) == [(-2.5, -3.0), (0.5, -3.0), (0.5, 0.5), (1.0, -3.0)]
    t = lambda df, *c: df.select("k", *[F.timestamp_millis((F.col(x) * 1000).cast("long")).alias(x) for x in c])
    assert ranges.within(t(p, "x"), t(i, "lo", "hi"), ["k"], "x", "lo", "hi", 1.0).count() == 4


def test_a_thousand_events_on_a_million_bars(spark):
    """One symbol: work follows the events, not the symbol's rows."""
    n = 1_000_000
    bars = spark.range(n).select(F.lit("A").alias("symbol"), F.date_add(F.lit(datetime.date(1600, 1, 1)), F.col("id").cast("int")).alias("date"), *[F.lit(v).alias(c) for c, v in (("open", 10.0), ("high", 11.0), ("low", 9.0), ("close", 10.0))])
    bars = bars.withColumn("high", F.when(F.datediff("date", F.lit(datetime.date(1600, 1, 1))) % 1000 == 30, 20.0).otherwise(F.col("high")))
    events = spark.range(1000).select(F.lit("A").alias("symbol"), F.lit("p").alias("pattern"), F.date_add(F.lit(datetime.date(1600, 1, 1)), (F.col("id") * 1000).cast("int")).alias("date"), F.lit(1).alias("dir"), F.lit(5.0).alias("stop"), F.lit(15.0).alias("target"))
    began = time.time()
    got = labels.measured_moves(events, bars).groupBy("result", "exit_day").count().collect()
    assert [(r.result, r.exit_day, r["count"]) for r in got] == [("target", 30, 1000)] and time.time() - began < 60
