"""Scans as windows against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scans
from tickloom.operators import patterns, signals


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", range(3))
def test_machine(spark, seed):
    rng = random.Random(seed)
    rows = [(s, i, *[rng.choice([True, False, False, None]) for _ in range(2)], rng.random() > 0.1 or None) for s in "AB" for i in range(400)]
    got = signals.toggles(spark.createDataFrame(rows, "symbol string, date int, e boolean, x boolean, k boolean").repartition(4), "e", "x", "s", "k")
    assert "Python" not in plan(got) and "Pandas" not in plan(got)
    said = {(r.symbol, r.date): r.s for r in got.collect()}
    state = defaultdict(int)
    for s, i, e, x, k in rows:
        state[s] = 0 if not k else (0 if x else 1) if state[s] else int(bool(e))
        assert said[s, i] == state[s]


@pytest.mark.parametrize("low, block", [(0.55, 500), (0.99, 7), (1.0, 500)])
def test_affine(spark, low, block):
    """Long series, also with the smallest factors all along; a key without a start; one that starts late."""
    rng = random.Random(4)
    n, rows = 3000, []
    for s, first in (("A", 0), ("B", 17), ("C", None), (None, 1)):
        rows += [(s, i, rng.uniform(low, 1.0) if s != "A" else low, rng.uniform(0, 3), 5.0 if i == first or (s == "B" and i == 40) else None) for i in range(n if s == "A" else 60)]
    df = spark.createDataFrame(rows, "symbol string, date int, a double, b double, s double").repartition(4)
    got = scans.affine(df, F.col("a"), F.col("b"), F.col("s"), "y", block=block)
    assert "Python" not in plan(got) and got.columns == ["symbol", "date", "a", "b", "s", "y"]
    said, y = {(r.symbol, r.date): r.y for r in got.collect()}, {}
    assert len(said) == len(rows)
    for s, i, a, b, start in rows:
        y[s] = start if y.get(s) is None else a * y[s] + b
        assert (said[s, i] is None) == (y[s] is None) and (y[s] is None or abs(said[s, i] - y[s]) <= 1e-9 * max(1, abs(y[s])))


@pytest.mark.parametrize("seed, gap, spread", [(0, 10, 3), (1, 10, 12), (2, 1, 2), (3, 25, 6)])
def test_apart(spark, seed, gap, spread):
    rng = random.Random(seed)
    events = []
    for s in "ABC":
        for p in ("x", "y"):
            t = 0
            for k in range(rng.choice([0, 1, 60, 200])):
                t += rng.randint(0, spread) if k % 37 else 3 * gap
                events.append((s, p, t, rng.random()))
    got = patterns.kept_apart(spark.createDataFrame(events, "symbol string, pattern string, t int, v double").repartition(3), gap)
    assert "Python" not in plan(got)
    want, by = set(), defaultdict(list)
    for s, p, t, v in events:
        by[s, p].append((t, v))
    for (s, p), rows in by.items():
        want |= {(s, p, t, v) for t, v in patterns.spaced_out(sorted(rows), gap)}
    assert {tuple(r) for r in got.collect()} == want


def test_apart_on_one_hot_symbol(spark):
    """300,000 events of one symbol: a stretch where every bar has one, a third of all, is a single chain of 10,000."""
    n = 300_000
    events = spark.range(n).select(F.lit("A").alias("symbol"), F.lit("x").alias("pattern"), F.when(F.col("id") < n // 3, F.col("id")).otherwise(F.col("id") * 7).cast("int").alias("t"))
    got = [r.t for r in patterns.kept_apart(events).select("t").orderBy("t").collect()]
    ts = [i if i < n // 3 else i * 7 for i in range(n)]
    assert got == [t for t, _ in patterns.spaced_out([(t, {}) for t in ts])]
