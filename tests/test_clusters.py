"""Clusters of columns by a recursive query, and their keepers, against union-find."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tickloom.operators import stats


def united(names, links):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {n: min(names.index(m) for m in names if find(m) == find(n)) for n in names}


@pytest.mark.parametrize("seed,share", [(0, 0.02), (1, 0.05), (2, 0.2), (3, 1.0), (4, 0.0)])
def test_clusters(spark, seed, share):
    rng = random.Random(seed)
    names = [f"c{i:02d}" for i in range(30)]
    rho = [(a, b, rng.choice((-1, 1)) * rng.uniform(0.61, 1) if rng.random() < share else rng.uniform(-0.6, 0.6)) for i, a in enumerate(names) for b in names[i + 1 :]]
    got = stats.correlation_clusters(spark.createDataFrame(rho, "a string, b string, rho double"), names)
    assert {r["name"]: r["cluster"] for r in got.collect()} == united(names, [(a, b) for a, b, x in rho if abs(x) > 0.6])


def test_a_chain_of_sixty(spark):
    names = [f"n{i:02d}" for i in range(60)]
    rho = [(a, b, 0.9) for a, b in zip(names, names[1:])]
    random.Random(5).shuffle(rho)
    got = stats.correlation_clusters(spark.createDataFrame(rho, "a string, b string, rho double"), names)
    assert {r["cluster"] for r in got.collect()} == {0}


def test_keepers(spark):
    rho = spark.createDataFrame([("a", "b", 0.7), ("b", "c", -0.8), ("a", "c", 0.1), ("a", "d", None), ("b", "d", float("nan")), ("c", "d", 0.2), ("d", "e", 0.9), ("a", "e", 0.0), ("b", "e", 0.0), ("c", "e", 0.0)], "a string, b string, rho double")
    clusters = stats.correlation_clusters(rho.na.drop(), list("abcdef"))
    scores = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", -2.0), ("d", None)], "name string, score double")
    got = {r["name"]: tuple(r)[2:] for r in stats.cluster_keepers(clusters, rho, scores).collect()}
    assert got == {
        "a": (3, 1.0, 0.8, False, True), "b": (3, 1.0, 0.8, True, True), "c": (3, -2.0, 0.8, False, True),
        "d": (2, None, 0.9, False, False), "e": (2, None, 0.9, True, False), "f": (1, None, None, True, False),
    }


def test_constant_columns(spark):
    """A column that never changes has no correlation (NaN, as in the SQL), and that is no error."""
    rows = spark.createDataFrame([(1, 2, 1.0, None), (1, 4, 2.0, 5.0), (1, 1, 4.0, 5.0), (1, 7, None, 5.0)], "k int, x int, y double, z double")
    got = {(r.a, r.b): r.rho for r in stats.correlations(rows, ["k", "x", "y", "z"]).collect()}
    assert all(math.isnan(got[p]) for p in (("k", "x"), ("k", "y"), ("k", "z"), ("x", "z"), ("y", "z")))
    assert got["x", "y"] == pytest.approx(np.corrcoef([2, 4, 1], [1.0, 2.0, 4.0])[0, 1])
    assert stats.correlations(rows.where("false"), ["k", "x"]).first().rho is None
    clusters = stats.correlation_clusters(stats.correlations(rows.drop("z"), ["k", "x", "y"]), ["k", "x", "y"])
    assert {r["cluster"] for r in clusters.collect()} == {0}


def test_equal_ranks_on_a_date(spark):
    day = lambda d, xs, ys: [(d, x, y) for x, y in zip(xs, ys)]
    rows = spark.createDataFrame(day("a", (1.0, 1.0, 1.0), (1.0, 2.0, 3.0)) + day("b", (1.0, 2.0, 3.0), (2.0, 4.0, 9.0)), "date string, s double, r double")
    assert [(r.n, r.ic) for r in stats.rank_ic(rows, "s", "r").collect()] == [(1, pytest.approx(1.0))]
