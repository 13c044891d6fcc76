"""The feature table's plans stay shallow, and boosting goes over what it has kept."""

from __future__ import annotations

import pytest
from test_boosting import FEATURES, drawn, tables

from tickloom.operators import boosting
from tickloom.operators import indicators as ind
from tickloom.sources.bars import trade_bars


class Seen(Exception):
    pass


def lines(df) -> list[str]:
    return df._jdf.queryExecution().sparkPlan().toString().splitlines()


def test_no_part_of_the_feature_table_is_deep(spark, monkeypatch):
    parts, kept = [], ind.kept
    monkeypatch.setattr(ind, "kept", lambda df: parts.append(df) or kept(df))
    parts.append(ind.feature_table(trade_bars(spark, "/root/testdata/sf0.001")))
    # an operator is three levels of JSON in the event log, which takes 1,000 of them
    assert all(max(line.find("- ") // 3 + 1 for line in lines(df)) < 120 for df in parts)


def test_rows_are_kept_before_they_are_weighed(spark, monkeypatch):
    def seen(rows):
        assert not any("Join" in line for line in lines(rows))
        raise Seen

    monkeypatch.setattr(boosting, "balanced", seen)
    with pytest.raises(Seen):
        boosting.boosted_rows(*tables(spark, *drawn(0)), FEATURES)


def test_a_level_is_one_exchange(spark):
    rows = spark.createDataFrame([(1, "train", 0, 1.0, [1, 2], [0.0, 0.0], [0, 0])], "fold int, role string, y int, w double, x array<int>, margins array<double>, nodes array<int>")
    plan = boosting.best_splits(boosting._sums(rows, 2, 2, 4, 0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
