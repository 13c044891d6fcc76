"""The streaming backtest against the batch engine: phantom and missing bars, batches of any cut, late bars, series that end."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.operators import backtest as bt
from tickloom.streaming import bars as st

BARS = "symbol string, date timestamp, open double, high double, low double, close double, volume double, signal int"
DAY = timedelta(days=1)


def drawn(seed: int, symbols: int, days: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    for s in range(symbols):
        price = 100.0
        for k in range(days):
            if rng.random() < 0.1:
                continue
            price *= rng.uniform(0.95, 1.05)
            o, c = price * rng.uniform(0.98, 1.02), price
            kind = rng.random()
            row = (o, max(o, c) * 1.01, min(o, c) * 0.99, c, 10.0) if kind > 0.15 else (c, c, c, c, 0.0) if kind > 0.08 else (None, None, None, None, None) if kind > 0.04 else (o, o, o, None, 1.0)
            out.append((f"s{s}", datetime(2020, 1, 1) + k * DAY, *row, rng.choice((0, 1, 1, None))))
    return out


def streamed(spark, folder: str, batches: list[list[tuple]], **kw) -> list:
    for rows in batches:
        spark.createDataFrame(rows, BARS).write.mode("append").parquet(f"{folder}/in")
        schema = spark.createDataFrame([], BARS).schema
        st.drained(st.backtest_stream(st.event_stream(spark, f"{folder}/in", schema), **kw), folder)
    return spark.read.parquet(f"{folder}/rows").collect()


def told(rows) -> dict:
    return {(r["symbol"], str(r["date"])): (r["position"], r["entry"], r["exit"], *(round(r[c], 9) for c in ("gross_ret", "net_ret", "gross_equity", "net_equity"))) for r in rows}


def test_five_batches_equal_the_batch_engine(spark, tmp_path):
    rows = drawn(3, 4, 120)
    cuts = [datetime(2020, 1, 1) + k * DAY for k in (10, 11, 50, 90, 400)]
    batches, at = [], datetime.min
    for cut in cuts:
        batches.append(random.Random(1).sample(part := [r for r in rows if at <= r[1] < cut], len(part)))
        at = cut
    far = ("end", datetime(2022, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 0)
    got = told(streamed(spark, str(tmp_path), [*batches, [far]], ends_after="100 days"))
    want = told(bt.backtest(spark.createDataFrame(rows, BARS)).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("gross_ret", "net_ret")}).collect())
    assert got == want and any(v[2] for v in want.values())


def test_late_bars_and_ended_series(spark, tmp_path):
    bar = lambda day, close, signal: ("a", datetime(2020, 1, 1) + day * DAY, close, close * 1.1, close * 0.9, close, 1.0, signal)
    other = lambda day: ("b", *bar(day, 1.0, 0)[1:])
    batches = [[bar(0, 10.0, 1), bar(1, 11.0, 1)], [bar(2, 12.0, 1)], [bar(1, 99.0, 0), bar(3, 12.0, 1)], [other(60)], [bar(61, 20.0, 1), bar(62, 30.0, 1)], [other(200)]]
    got = {k: v for k, v in told(streamed(spark, str(tmp_path), batches, ends_after="30 days")).items() if k[0] == "a"}
    first = spark.createDataFrame([bar(0, 10.0, 1), bar(1, 11.0, 1), bar(2, 12.0, 1), bar(3, 12.0, 1)], BARS)
    again = spark.createDataFrame([bar(61, 20.0, 1), bar(62, 30.0, 1)], BARS)
    assert got == {**told(bt.backtest(first).collect()), **told(bt.backtest(again).collect())}
