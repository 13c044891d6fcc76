"""Window functions, indicators, signals and backtests against loops and hand-made frames."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import rolling as r
from tickloom.functions.ewm import ewm
from tickloom.operators import adjust, backtest, calendar, indicators, labels, models, patterns, signals, splits, stats
from tickloom.sources import bars as src
from tickloom.sources import sinks

DAY = datetime.date(2000, 1, 3)
BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def frame(spark, closes, opens=None, symbol="A", spread=1.0, volume=100.0, start=DAY):
    opens = opens or closes
    rows = []
    for i, (c, o) in enumerate(zip(closes, opens)):
        known = c is not None and o is not None
        rows.append((symbol, start + datetime.timedelta(i), None if o is None else float(o), max(c, o) + spread if known else None, min(c, o) - spread if known else None, None if c is None else float(c), volume))
    return spark.createDataFrame(rows, BARS)


def walk(n, seed=0):
    rng = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(rng.gauss(0, 0.02)))
    return out


def values(df, column):
    return [x[column] for x in df.orderBy("symbol", "date").select(column, "symbol", "date").collect()]


def near(a, b, rel=1e-9):
    return all((x is None or (isinstance(x, float) and math.isnan(x))) == (y is None or (isinstance(y, float) and math.isnan(y))) and (x is None or y is None or math.isclose(x, y, rel_tol=rel, abs_tol=1e-9)) for x, y in zip(a, b))


@pytest.mark.parametrize("alpha", [1 / 14, 0.2, 0.5, 0.9])
def test_ewm_against_pandas(spark, alpha):
    """Longer than a block at every alpha, with gaps."""
    x = [None if i % 37 == 5 else v for i, v in enumerate(walk(3000))]
    df = frame(spark, x)
    s = pd.Series(x, dtype=float)
    for mode, want in (("recursive", s.dropna().ewm(alpha=alpha, adjust=False).mean()), ("weighted", s.dropna().ewm(alpha=alpha, adjust=True).mean())):
        assert near(values(ewm(df, F.col("close"), "y", alpha, mode), "y"), want.reindex(s.index).ffill().tolist(), 1e-8)
    d = s.dropna()
    seeded = pd.concat([pd.Series([d.iloc[:12].mean()], index=[d.index[11]]), d.iloc[12:]]).ewm(alpha=alpha, adjust=False).mean()
    want = [None if i < d.index[11] else v for i, v in enumerate(seeded.reindex(s.index).ffill())]
    assert near(values(ewm(df, F.col("close"), "y", alpha, "seeded", seed=12), "y"), want, 1e-8)


def test_rolling_against_pandas(spark):
    x = walk(200)
    s, df = pd.Series(x), frame(spark, x)
    c = F.col("close")
    assert near(values(df.withColumn("y", r.rolling_skew(c, 30)), "y"), s.rolling(30).skew().tolist(), 1e-6)
    assert near(values(df.withColumn("y", r.rolling_median(c, 21, 5)), "y"), s.rolling(21, min_periods=5).median().tolist())
    assert near(values(df.withColumn("y", r.zscore(c, 20)), "y"), ((s - s.rolling(20).mean()) / s.rolling(20).std()).tolist(), 1e-6)
    assert near(values(df.withColumn("y", r.rolling_rank(c, 60, 20)), "y"), s.rolling(60, min_periods=20).rank(pct=True).tolist())
    slope, at = r.rolling_line(c, 10, F.col("i"))
    got = df.withColumn("i", F.row_number().over(r.series())).withColumn("y", slope).withColumn("z", at)
    want = [np.polyfit(range(10), x[i - 10 : i], 1) if i >= 10 else None for i in range(200)]
    assert near(values(got, "y"), [None if w is None else float(w[0]) for w in want], 1e-6) and near(values(got, "z"), [None if w is None else float(w[0] * 10 + w[1]) for w in want], 1e-6)


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("A", DAY, 1.0), ("B", DAY, 2.0), ("C", DAY, 2.0), ("D", DAY, 9.0), ("E", DAY, None)], "symbol string, date date, x double")
    assert values(df.withColumn("y", r.section_rank(F.col("x"))), "y") == [0.25, 0.625, 0.625, 1.0, None]


CAUSAL = {
    "votes": lambda d: indicators.votes(d), "rsi": lambda d: indicators.rsi_features(d), "long": lambda d: indicators.long_term_features(d), "volume": lambda d: indicators.volume_weighted_move(indicators.accumulation(indicators.obv(d))),
    "score": lambda d: indicators.next_candle_score(d), "rules": lambda d: signals.rsi_rules(signals.simple_rules(d)), "bands": lambda d: signals.band_rules(d), "divergence": lambda d: signals.divergence_rule(d), "candles": lambda d: patterns.candle_signals(indicators.atr_wilder(d, 14, "atr")),
}


@pytest.mark.parametrize("name", sorted(CAUSAL))
def test_nothing_looks_ahead(spark, name):
    """What is known on bars up to a cut does not change when later bars are there."""
    df = frame(spark, walk(320), [x * 1.003 for x in walk(320)])
    cut = DAY + datetime.timedelta(280)
    made = CAUSAL[name](df)
    columns = sorted(c for c in made.columns)
    early = CAUSAL[name](df.where(F.col("date") <= F.lit(cut))).select(columns).orderBy("date").collect()
    late = made.where(F.col("date") <= F.lit(cut)).select(columns).orderBy("date").collect()
    assert all(near([x if isinstance(x, float) else None for x in a], [x if isinstance(x, float) else None for x in b]) and [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)] for a, b in zip(early, late))


def test_pivots_need_the_whole_frame(spark):
    df = frame(spark, [1, 2, 3, 4, 5, 9, 5, 4, 3, 2, 1, 2])
    assert [i for i, x in enumerate(values(df.withColumn("p", r.is_pivot(F.col("close"), 5, True)), "p")) if x] == [5]


def test_hysteresis_and_toggles(spark):
    x = [50, 25, 40, 55, 20, None, 40, 28, 45]
    df = frame(spark, x)
    c = F.col("close")
    assert values(df.withColumn("s", signals.hysteresis(c < 30, c > 50, c.isNotNull())), "s") == [0, 1, 1, 0, 1, 0, 0, 1, 1]
    both = df.withColumn("i", c > 20).withColumn("o", c > 40)  # both hold over 40: in, out, in ...
    assert values(signals.toggles(both, "i", "o", "s"), "s") == [1, 1, 1, 0, 0, 0, 1, 1, 0]


# backtest


def loop(bars, signal, cost):
    """The rules, one bar at a time."""
    position, mark, out = 0, None, []
    for i, (o, h, low, c, v) in enumerate(bars):
        want = signal[i - 1] if i else 0
        can = o is not None and c is not None and not (o == h == low == c and v == 0)
        now = want if can else position
        if now and not position:
            g, mark = c / o - 1, c
        elif now:
            g = 0.0 if c is None else c / mark - 1
            mark = mark if c is None else c
        elif position:
            g = o / mark - 1
        else:
            g = 0.0
        out_now = (position and not now) or (i == len(bars) - 1 and now)
        out.append((now, g, (1 + g) * (1 - cost) - 1 if out_now else g))
        position = now
    return out


def test_backtest_against_the_loop(spark):
    rng, rows, want = random.Random(4), [], {}
    for k in range(40):
        price, bars, sig = 100.0, [], []
        for _ in range(60):
            price *= math.exp(rng.gauss(0, 0.03))
            o, c = price, price * math.exp(rng.gauss(0, 0.01))
            kind = rng.random()
            bars.append((None, None, None, None, 0.0) if kind < 0.08 else (c, c, c, c, 0.0) if kind < 0.18 else (o, max(o, c) * 1.01, min(o, c) * 0.99, c, 10.0))
            sig.append(int(rng.random() < 0.5))
        want[f"S{k:02}"] = loop(bars, sig, 0.0035)
        rows += [(f"S{k:02}", DAY + datetime.timedelta(i), *b, s) for i, (b, s) in enumerate(zip(bars, sig))]
    df = spark.createDataFrame(rows, BARS + ", signal int")
    got = backtest.backtest(df).orderBy("symbol", "date").select("position", "gross_ret", "net_ret").collect()
    for a, b in zip(got, [x for k in sorted(want) for x in want[k]]):
        assert a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-12) and math.isclose(a[2], b[2], abs_tol=1e-12)


def run(spark, closes, opens, signal, cost=0.0):
    df = frame(spark, closes, opens).withColumn("n", F.row_number().over(r.series()) - 1)
    return backtest.backtest(df.withColumn("signal", F.get(F.array(*[F.lit(s) for s in signal]), F.col("n"))), "signal", cost)


def test_backtest_identities(spark):
    gap = backtest.trades(run(spark, [100, 110, 110, 110], [100, 110, 110, 110], [1, 1, 1, 1])).first()
    assert gap.gross_return == pytest.approx(0) and gap.forced
    out = backtest.trades(run(spark, [100, 100, 110, 110], [100, 100, 110, 110], [1, 0, 0, 0])).first()
    assert out.gross_return == pytest.approx(0.10) and not out.forced and out.bars_held == 1
    held = backtest.trades(run(spark, [100, 100, None, 120, 120], [100, 100, None, 120, 120], [1, 1, 1, 0, 0])).first()
    assert held.gross_return == pytest.approx(0.20)
    hold = backtest.buy_and_hold(frame(spark, [100, 105, 99, 120], [100, 104, 100, 118]), 0.01).orderBy(F.desc("date")).first()
    assert hold.net_equity == pytest.approx(120 / 104 * 0.99)
    many = run(spark, walk(60), walk(60, 1), [i // 3 % 2 for i in range(60)], 0.01).orderBy("date").collect()
    assert many[-1].net_equity == pytest.approx(many[-1].gross_equity * 0.99 ** sum(x.exit for x in many))


def test_metrics_of_a_flat_series(spark):
    m = backtest.metrics(run(spark, [100] * 5, [100] * 5, [0] * 5)).first()
    assert m.total == 0 and m.sharpe is None and m.max_dd == 0 and m.exposure == 0


# actions


def acts(spark, *rows):
    return spark.createDataFrame([("A", DAY + datetime.timedelta(d), k, x, cash, "t", conf) for d, k, x, cash, conf in rows], "symbol string, ex_date date, action_type string, ratio double, dividend_amount double, source string, confidence string")


def test_bonus_makes_prices_flat_and_volume_comparable(spark):
    df = frame(spark, [200] * 5 + [100] * 5)
    out = adjust.adjusted(df, acts(spark, (5, "bonus", 2.0, None, "HIGH")))
    assert values(out, "adj_close") == [100.0] * 10 and values(out, "adj_volume") == [200.0] * 5 + [100.0] * 5
    assert [x.verdict for x in adjust.folded(df, acts(spark, (5, "bonus", 2.0, None, "HIGH"))).collect()] == ["NOT_FOLDED"]
    assert adjust.residual_jumps(out, acts(spark, (5, "bonus", 2.0, None, "HIGH"))).count() == 0


def test_folded_split_is_not_applied_twice(spark):
    df = frame(spark, [100] * 10)
    a = acts(spark, (5, "split", 2.0, None, "HIGH"))
    assert adjust.folded(df, a).first().verdict == "FULLY_PREFOLDED" or adjust.folded(df, a).first().verdict == "PREFOLDED"
    assert set(values(adjust.with_divisors(df, a), "divisor")) == {1.0} and values(adjust.with_divisors(df, a, "always"), "divisor")[0] == 2.0


def test_two_actions_on_a_day(spark):
    df = frame(spark, [300] * 5 + [100] * 5)
    a = acts(spark, (5, "split", 2.0, None, "HIGH"), (5, "bonus", 1.5, None, "HIGH"))
    assert adjust.folded(df, a).first().verdict == "NOT_FOLDED" and values(adjust.with_divisors(df, a), "divisor") == [3.0] * 5 + [1.0] * 5


def test_blank_ratio_cuts_a_segment(spark):
    out = adjust.with_quality(frame(spark, [100] * 6), acts(spark, (3, "demerger", None, None, "UNVERIFIED")))
    assert values(out, "segment_id") == [0, 0, 0, 1, 1, 1] and values(out, "quality") == ["UNCROSSABLE"] * 3 + [""] * 3


def test_anchor_is_the_next_bar(spark):
    got = adjust.anchored(frame(spark, [1, 2, 3]).where("close <> 2"), acts(spark, (1, "split", 2.0, None, ""), (9, "split", 2.0, None, ""))).orderBy("ex_date").collect()
    assert [x.anchor for x in got] == [DAY + datetime.timedelta(2), None]


def test_dividend_is_in_the_money_of_the_bar_before(spark):
    df = adjust.with_divisors(frame(spark, [200] * 3 + [100] * 3), acts(spark, (3, "split", 2.0, None, "")), "always")
    out = adjust.with_dividends(df, acts(spark, (3, "dividend", None, 8.0, "")))
    assert values(out, "dividend_raw")[3] == 8.0 and values(out, "dividend")[3] == 4.0


def test_artifact_takes_the_index_return(spark):
    df = frame(spark, [100, 100, 50, 50])
    day = [DAY + datetime.timedelta(i) for i in range(4)]
    idx = spark.createDataFrame(list(zip(day, [10.0, 10.0, 11.0, 11.0])), "date date, level double")
    out = adjust.repaired(df, spark.createDataFrame([("A", day[2])], "symbol string, date date"), idx)
    assert near(values(out, "close"), [50 / 1.1, 50 / 1.1, 50.0, 50.0])


# calendar, labels, splits


def test_alignment_starts_with_the_first_bar(spark):
    one, two = frame(spark, [1] * 8, symbol="A"), frame(spark, [1, None, 1], symbol="B", start=DAY + datetime.timedelta(3)).where("close is not null")
    both = one.unionByName(two)
    out = calendar.aligned(both, calendar.trading_calendar(both)).where("symbol = 'B'").orderBy("date").collect()
    assert out[0].date == DAY + datetime.timedelta(3) and [x.no_data for x in out] == [False, True, False, False, False] and [x.post_delisting for x in out] == [False] * 3 + [True] * 2


def test_identical_bars(spark):
    assert [x.n for x in calendar.identical_runs(frame(spark, [1, 2, 2, 2, 2, 3])).collect()] == [4]


def test_membership_of_an_unknown_date(spark):
    panel = spark.createDataFrame([(DAY, "A", True), (DAY, "B", False)], "date date, symbol string, in_universe boolean")
    assert [x.symbol for x in calendar.members(panel, str(DAY)).collect()] == ["A"]
    with pytest.raises(KeyError):
        calendar.members(panel, "1999-01-01")


def test_bar_that_touches_both_barriers_is_down(spark):
    df = frame(spark, [100] * 30).withColumn("high", F.when(F.dayofmonth("date") == 25, 200.0).otherwise(F.col("high"))).withColumn("low", F.when(F.dayofmonth("date") == 25, 1.0).otherwise(F.col("low")))
    got = {x.date.day: x.label for x in labels.triple_barrier(df).where("label is not null").collect()}
    assert got[16] == "Down" and got[22] == "Down"


def test_labels_against_a_loop(spark):
    closes = walk(120, 3)
    df = frame(spark, closes, spread=0.5)
    bars = df.orderBy("date").collect()
    tr = [b.high - b.low if i == 0 else max(b.high - b.low, abs(b.high - bars[i - 1].close), abs(b.low - bars[i - 1].close)) for i, b in enumerate(bars)]
    for x, i in zip(labels.triple_barrier(df).orderBy("date").collect(), range(120)):
        if i < 13:
            assert x.dropped_reason == "insufficient_atr_warmup"
        elif i + 10 >= 120:
            assert x.dropped_reason == "insufficient_forward_window"
        else:
            atr = sum(tr[i - 13 : i + 1]) / 14
            want = "Sideways"
            for b in bars[i + 1 : i + 11]:
                if b.low <= bars[i].close - atr:
                    want = "Down"
                    break
                if b.high >= bars[i].close + 2 * atr:
                    want = "Up"
                    break
            assert x.label == want


def test_folds_do_not_overlap(spark):
    df = frame(spark, walk(400))
    cal = calendar.trading_calendar(df)
    kept = splits.with_window_end(labels.triple_barrier(df).where("dropped_reason is null"), cal)
    ranges = spark.createDataFrame([(1, DAY + datetime.timedelta(150), DAY + datetime.timedelta(200)), (2, DAY + datetime.timedelta(250), DAY + datetime.timedelta(300))], "fold int, test_start date, test_end date")
    f = splits.folds(kept, ranges, cal)
    ends = f.where("role = 'train'").join(kept, ["symbol", "date"]).join(ranges, "fold")
    assert splits.overlap(f).count() == 0 and ends.where("window_end >= test_start").count() == 0
    n = {k: splits.folds(kept, ranges, cal, rule=k).where("fold = 2 and role = 'train'").count() for k in ("embargo_shadow", "drop_all_after_prior_test")}
    assert n["drop_all_after_prior_test"] < n["embargo_shadow"]


def test_outcomes_by_hand(spark):
    df = frame(spark, [100, 100, 103, 100], [100, 100, 100, 100], spread=0.4).withColumn("atr", F.lit(2.0))
    got = labels.outcomes(df, 1, 1.0, 3).orderBy("date").first()
    assert got.out_win == 1 and got.out_day == 2 and got.out_ret == pytest.approx(0.02)


# patterns, statistics, sinks


def test_zigzag_alternates():
    x = np.array([math.sin(i / 5) for i in range(200)])
    *_, (known, z) = patterns.zigzags(x + 0.1, x - 0.1)
    assert len(z) > 8 and all(a.kind == -b.kind for a, b in zip(z, z[1:])) and known == z[-1].bar + 5


def test_spaced_out_counts_from_the_last_kept():
    assert [t for t, _ in patterns.spaced_out([(0, {}), (6, {}), (12, {}), (18, {}), (23, {})])] == [0, 12, 23]


def test_double_bottom_breaks_out(spark):
    legs = [(60, 140, 100), (12, 100, 112), (12, 112, 100.5), (30, 100.5, 130)]
    shape = [a + (b - a) * i / n for n, a, b in legs for i in range(n)]
    df = frame(spark, shape, spread=0.2).withColumn("atr", F.lit(1.0))
    found = {x.pattern: x for x in patterns.chart_events(df).collect()}
    assert "Double Bottom" in found
    e = found["Double Bottom"]
    assert e.dir == 1 and e.trigger == pytest.approx(112.2, abs=0.5) and e.stop < 101 and e.target == pytest.approx(e.trigger + e.height)


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(DAY + datetime.timedelta(i), float(v)) for i, v in enumerate(np.random.default_rng(0).normal(1, 1, 300))], "date date, v double")
    b = stats.bootstrap(df, "v", 10, 200)
    row = b.first()
    assert row.low < row.estimate < row.high and 0.8 < row.estimate < 1.2
    assert tuple(stats.bootstrap(df, "v", 10, 200).first()) == pytest.approx(tuple(row))  # seeded; only the order of sums is free


def test_shuffled_labels_keep_their_counts(spark):
    df = spark.createDataFrame([("A", DAY + datetime.timedelta(i), i % 3) for i in range(60)], "symbol string, date date, y int")
    out = models.shuffled(df, "y", ["symbol"])
    assert sorted(values(out, "y")) == sorted(values(df, "y")) and values(out, "y") != values(df, "y")


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = x @ [1.0, -2.0] + 0.5 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    icpt, beta = models.ridge_normal(df, ["a", "b"], "y", 10.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ yc)
    assert np.allclose([beta["a"], beta["b"]], want) and math.isclose(icpt, y.mean() - x.mean(0) @ want)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2000-01-03,1,2,0.5,1.5,1.5,10\n2000-01-03,1,2,0.5,1.6,1.6,10\n2000-01-04,x,2,0.5,nan,1.5,\n")
    got = src.read_bar_files(spark, f"{tmp_path}/*.csv").orderBy("date").collect()
    assert [(x.symbol, x.close, x.open) for x in got] == [("AAA", 1.6, 1.0), ("AAA", None, None)]
    sinks.write_csv(frame(spark, [1, 2]), f"{tmp_path}/out")
    sinks.write_parquet(frame(spark, [1, 2]), f"{tmp_path}/parquet", by=["symbol"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2 and spark.read.parquet(f"{tmp_path}/parquet").count() == 2
    head = sinks.provenance(spark, f"{tmp_path}/*.csv")
    assert set(head["inputs"]) == {"AAA.csv"} and "```json" in sinks.report_text("t", head, "b")
    assert sinks.dashboard_json(spark.createDataFrame([(1, float("nan"))], "a int, b double")).first().value == '{"a":1,"b":null}'


def test_stream_equals_batch(spark, tmp_path):
    from tickloom.streaming import bars as st

    ticks = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=7 * i), "A", float(i % 13), i) for i in range(200)], "ts timestamp, symbol string, value double, event_id long")
    ticks.write.parquet(f"{tmp_path}/ticks")
    q = st.windowed_bars(st.event_stream(spark, f"{tmp_path}/ticks", ticks.schema)).writeStream.outputMode("complete").format("memory").queryName("t_bars").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(x) for x in spark.table("t_bars").collect()} == {tuple(x) for x in st.windowed_bars(ticks).collect()}
    bars = st.windowed_bars(ticks).select("symbol", "start", "close")
    bars.write.parquet(f"{tmp_path}/bars")
    q = st.hysteresis_stream(st.event_stream(spark, f"{tmp_path}/bars", bars.schema), "close", 3, 8).writeStream.outputMode("append").format("memory").queryName("t_state").trigger(availableNow=True).start()
    q.awaitTermination()
    state, want = 0, []
    for x in bars.orderBy("start").collect():
        state = 1 if x.close < 3 else 0 if x.close > 8 else state
        want.append(state)
    assert [x.state for x in spark.table("t_state").orderBy("start").collect()] == want
