"""Purged walk-forward folds, calibration slices, combinatorial plans."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .calendar import session_offset


def with_window_end(labels: DataFrame, calendar: DataFrame, horizon: int = 10) -> DataFrame:
    """``window_end``: the touch date, else ``horizon`` sessions on; never before the date."""
    df = session_offset(labels, calendar, "date", horizon, "tl_end")
    return df.withColumn("window_end", F.greatest("date", F.coalesce("touch_date", "tl_end"))).drop("tl_end")


def folds(labels: DataFrame, ranges: DataFrame, calendar: DataFrame, embargo: int = 10, rule: str = "embargo_shadow") -> DataFrame:
    """fold, role (train, test), symbol, date. ``ranges``: fold, test_start, test_end; a row a fold, so it is broadcast.

    Test: in the range, resolved by its end. Train: resolved before the test starts and, by ``embargo_shadow``, not within
    ``embargo`` sessions after an earlier test's end; by ``drop_all_after_prior_test``, not after any earlier test's end at all.
    """
    shadow = session_offset(ranges, calendar, "test_end", embargo, "shadow_end").withColumn("shadow_end", F.coalesce("shadow_end", F.date_add("test_end", 2 * embargo)))
    each = labels.select("symbol", "date", "window_end").crossJoin(F.broadcast(shadow))
    test = each.where((F.col("date") >= F.col("test_start")) & (F.col("date") <= F.col("test_end")) & (F.col("window_end") <= F.col("test_end"))).select("fold", F.lit("test").alias("role"), "symbol", "date")
    train = each.where(F.col("window_end") < F.col("test_start"))
    prior = shadow.select(F.col("fold").alias("pf"), F.col("test_end").alias("pe"), F.col("shadow_end").alias("ps"))
    inside = (F.col("date") > F.col("pe")) & ((F.col("date") <= F.col("ps")) if rule == "embargo_shadow" else F.lit(True))
    train = train.join(F.broadcast(prior), (F.col("pf") < F.col("fold")) & inside, "left_anti")
    return test.unionByName(train.select("fold", F.lit("train").alias("role"), "symbol", "date"))


def overlap(assigned: DataFrame) -> DataFrame:
    """Rows that are both trained on and tested in a fold: none, if folds are right."""
    key = ["fold", "symbol", "date"]
    return assigned.where("role = 'train'").select(key).intersect(assigned.where("role = 'test'").select(key))


def calibration_slice(train: DataFrame, share: float = 0.2) -> DataFrame:
    """``part`` of training rows: calib for the last ``share`` of dates, fit for those resolved before it, NULL for what lies between."""
    n = train.select("date").distinct()
    cut = n.agg(F.percentile(F.datediff("date", F.lit("1970-01-01").cast("date")), F.lit(1 - share)).alias("c")).select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor("c").cast("int")).alias("tl_cut"))
    df = train.crossJoin(F.broadcast(cut))  # one row
    return df.withColumn("part", F.when(F.col("date") > F.col("tl_cut"), "calib").when(F.col("window_end") <= F.col("tl_cut"), "fit")).drop("tl_cut")


def date_blocks(samples: DataFrame, n: int = 10) -> DataFrame:
    """date, step, block: sample dates in n blocks, larger ones first."""
    s = Window.orderBy("date")
    return samples.select("date").distinct().withColumn("step", F.row_number().over(s) - 1).withColumn("block", F.ntile(n).over(s) - 1)


def combinatorial_choices(symbols: list[str], blocks: int = 10, test_blocks: int = 2, holdouts: int = 4, share: float = 0.3, seed: int = 0) -> list[tuple[tuple[int, ...], tuple[str, ...]]]:
    """(test blocks, held-out symbols) of each path: every choice of blocks with several random sets of symbols, seeded."""
    rng, names = random.Random(seed), sorted(symbols)
    return [(pair, tuple(rng.sample(names, max(1, round(len(names) * share))))) for pair, _ in itertools.product(itertools.combinations(range(blocks), test_blocks), range(holdouts))]


def combinatorial_plan(spark: SparkSession, symbols: list[str], blocks: int = 10, test_blocks: int = 2, holdouts: int = 4, share: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(plan: path, block; held: path, symbol) of ``combinatorial_choices``."""
    choices = combinatorial_choices(symbols, blocks, test_blocks, holdouts, share, seed)
    plan, held = [(path, b) for path, (pair, _) in enumerate(choices) for b in pair], [(path, s) for path, (_, out) in enumerate(choices) for s in out]
    return spark.createDataFrame(plan, "path int, block int"), spark.createDataFrame(held, "path int, symbol string")


def combinatorial_roles(samples: DataFrame, plan: DataFrame, held: DataFrame, dates: DataFrame, purge: int = 6) -> DataFrame:
    """path, role, symbol, date: test on test blocks' held-out symbols, train on other symbols and on steps at least ``purge`` away from any test block."""
    rows = samples.select("symbol", "date").join(dates.select("date", "step", "block"), "date")
    test = rows.join(plan, "block").join(held, ["path", "symbol"]).select("path", F.lit("test").alias("role"), "symbol", "date")
    # which steps a path may train on is settled on dates alone, a row a path and date; the panel then joins by step
    near = plan.join(dates, "block").select("path", F.explode(F.sequence(F.col("step") - purge, F.col("step") + purge)).alias("step")).distinct()
    free = plan.select("path").distinct().crossJoin(dates.select("step")).join(near, ["path", "step"], "left_anti")
    train = rows.join(free, "step").join(held, ["path", "symbol"], "left_anti")
    return test.unionByName(train.select("path", F.lit("train").alias("role"), "symbol", "date"))


def yearly_walk_forward(samples: DataFrame, dates: DataFrame, purge: int = 6) -> DataFrame:
    """year, role, symbol, date: test on a year, train on steps that lie more than ``purge`` before its first."""
    rows = samples.select("symbol", "date").join(dates.select("date", "step"), "date").withColumn("y", F.year("date"))
    first = rows.groupBy(F.col("y").alias("year")).agg(F.min("step").alias("lo"))
    each = rows.crossJoin(F.broadcast(first))  # a row a year
    role = F.when(F.col("y") == F.col("year"), "test").when(F.col("step") < F.col("lo") - purge, "train")
    return each.withColumn("role", role).where("role is not null").select("year", "role", "symbol", "date")


def random_halves(symbols: DataFrame, seed: int = 0) -> DataFrame:
    """symbol, half (0, 1): by rank of a seeded hash."""
    order = Window.orderBy(F.xxhash64("symbol", F.lit(seed)))
    return symbols.select("symbol").distinct().withColumn("half", F.pmod(F.row_number().over(order), F.lit(2)))


def contiguous_segments(dates: DataFrame) -> DataFrame:
    """Rows (key, step) with ``segment``: steps without a gap have one number."""
    s = Window.partitionBy("key").orderBy("step")
    return dates.withColumn("segment", F.col("step") - F.row_number().over(s))
