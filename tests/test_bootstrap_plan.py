"""What a bootstrap broadcasts is the series, a row a date, never its draws."""

from __future__ import annotations

import datetime

import pytest

from tickloom.operators import stats


@pytest.mark.parametrize("circular", [True, False])
def test_draws_are_not_broadcast(spark, circular):
    rows = [(datetime.date(2000, 1, 1) + datetime.timedelta(days=i), float(i % 7)) for i in range(50)]
    daily = spark.createDataFrame(rows, "date date, v double")  # its size is not known, so taken for large
    got = stats.bootstrap(daily, "v", 5, 40, circular=circular)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in plan if "BroadcastHashJoin" in line]
    assert joins and all("BuildRight" in line for line in joins)
    r = got.first()
    assert r.n == 50 and r.low <= r.high and r.estimate == pytest.approx(sum(v for _, v in rows) / 50)
