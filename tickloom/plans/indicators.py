"""Queries of indicators, windows and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rolling as r
from ..functions.ewm import ewm
from ..functions.orderstats import Rolling, rolling_order
from ..operators import indicators as ind
from ..sources.bars import trade_bars
from .base import query, recursive, rounded, sql_ewm, sql_ewm_seeded, sql_ewm_weighted, with_bars

_W = "OVER (PARTITION BY symbol ORDER BY date)"


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(fn: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {_frame(n)} >= {n if least is None else least} THEN {fn}({x}) {_frame(n)} END"


_RSI = f"""d AS (SELECT symbol, date, close - lag(close) {_W} AS d, row_number() {_W} - 2 AS i FROM bars),
g AS (SELECT symbol, date, i, greatest(d, 0) AS u, greatest(-d, 0) AS n FROM d WHERE i >= 0)"""


def _rsi_sql(u: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN 100 - 100 / (1 + {u} / {n}) WHEN {u} > 0 THEN 100.0 END"


@query(
    "ind01_rsi_wilder",
    with_bars(f"""{_RSI}, m AS (SELECT symbol, date, i, {sql_ewm('u', 1 / 14)} AS u, {sql_ewm('n', 1 / 14)} AS n FROM g)
SELECT b.symbol, b.date, round(CASE WHEN i >= 13 THEN {_rsi_sql('u', 'n')} END, 6) AS rsi FROM bars b LEFT JOIN m ON b.symbol = m.symbol AND b.date = m.date"""),
)
def _(spark, d):
    return rounded(ind.rsi(trade_bars(spark, d)), ["symbol", "date", "rsi"])


@query(
    "ind02_rsi_seeded",
    with_bars(f"""{_RSI}, m AS (SELECT symbol, date, {', '.join(f"{sql_ewm_seeded(x, 1 / n, n)} AS {x}{n}" for n in (7, 14, 20) for x in ('u', 'n'))} FROM g)
SELECT b.symbol, b.date, {', '.join(f"round({_rsi_sql(f'u{n}', f'n{n}')}, 6) AS rsi{n}" for n in (7, 14, 20))} FROM bars b LEFT JOIN m ON b.symbol = m.symbol AND b.date = m.date"""),
)
def _(spark, d):
    df = trade_bars(spark, d)
    for n in (7, 14, 20):
        df = ind.rsi(df, n, f"rsi{n}", "seeded")
    return rounded(df, ["symbol", "date", "rsi7", "rsi14", "rsi20"])


@query(
    "ind03_rsi2",
    with_bars(f"""{_RSI}, l AS (SELECT symbol, date, i, list(u) OVER f AS us, list(n) OVER f AS ns FROM g WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 60 PRECEDING AND CURRENT ROW)),
m AS (SELECT symbol, date, i, list_reduce(us, lambda a, x: a * 0.5 + x * 0.5) AS u, list_reduce(ns, lambda a, x: a * 0.5 + x * 0.5) AS n FROM l)
SELECT b.symbol, b.date, round(CASE WHEN i >= 1 THEN {_rsi_sql('u', 'n')} END, 4) AS rsi2 FROM bars b LEFT JOIN m ON b.symbol = m.symbol AND b.date = m.date"""),
)
def _(spark, d):
    return rounded(ind.rsi(trade_bars(spark, d), 2, "rsi2"), ["symbol", "date", "rsi2"], 4)


_K = f"CASE WHEN {_roll('max', 'high', 14)} > {_roll('min', 'low', 14)} THEN 100 * (close - {_roll('min', 'low', 14)}) / ({_roll('max', 'high', 14)} - {_roll('min', 'low', 14)}) END"


@query(
    "ind04_05_06_oscillators",
    with_bars(f"""a AS (SELECT symbol, date, close, high, low, (high + low + close) / 3 AS t, {_K} AS k, {_roll('max', 'high', 14)} AS hh, {_roll('min', 'low', 14)} AS ll FROM bars),
b AS (SELECT *, {_roll('avg', 'k', 3)} AS stoch_k, {_roll('avg', 't', 20)} AS m, list(t) {_frame(20)} AS ts FROM a),
c AS (SELECT *, list_sum(list_transform(ts, lambda x: abs(x - m))) / 20 AS dev FROM b)
SELECT symbol, date, round(stoch_k, 6) AS stoch_k, round({_roll('avg', 'stoch_k', 3)}, 6) AS stoch_d, round(CASE WHEN dev > 0 THEN (t - m) / (0.015 * dev) END, 6) AS cci,
  round(CASE WHEN hh > ll THEN -100 * (hh - close) / (hh - ll) END, 6) AS willr FROM c"""),
)
def _(spark, d):
    return rounded(ind.williams_r(ind.cci(ind.stochastic(trade_bars(spark, d)))), ["symbol", "date", "stoch_k", "stoch_d", "cci", "willr"])


_N = f"n AS (SELECT *, row_number() {_W} - 1 AS i FROM bars)"


@query(
    "ind07_macd",
    with_bars(f"""{_N}, m AS (SELECT symbol, date, i, {sql_ewm('close', 2 / 13)} - {sql_ewm('close', 2 / 27)} AS line FROM n),
l AS (SELECT symbol, date, i - 25 AS i, line FROM m WHERE i >= 25), s AS (SELECT symbol, date, i, {sql_ewm('line', 0.2)} AS sig FROM l)
SELECT m.symbol, m.date, round(CASE WHEN m.i >= 25 THEN line END, 5) AS macd_line, round(CASE WHEN s.i >= 8 THEN sig END, 5) AS macd_signal, round(CASE WHEN s.i >= 8 THEN line - sig END, 5) AS macd_hist
FROM m LEFT JOIN s ON m.symbol = s.symbol AND m.date = s.date"""),
)
def _(spark, d):
    return rounded(ind.macd(trade_bars(spark, d)), ["symbol", "date", "macd_line", "macd_signal", "macd_hist"], 5)


@query("ind08_ema", with_bars(f"{_N} SELECT symbol, date, {', '.join(f'round({sql_ewm_seeded('close', 2 / (k + 1), k)}, 6) AS ema{k}' for k in (14, 20, 50))} FROM n"))
def _(spark, d):
    df = trade_bars(spark, d)
    for k in (14, 20, 50):
        df = ind.ema(df, k, f"ema{k}")
    return rounded(df, ["symbol", "date", "ema14", "ema20", "ema50"])


_TR = f"greatest(high - low, abs(high - lag(close) {_W}), abs(low - lag(close) {_W}))"


@query(
    "ind09_adx",
    with_bars(f"""d AS (SELECT symbol, date, row_number() {_W} - 2 AS i, high - lag(high) {_W} AS u, lag(low) {_W} - low AS n, {_TR} AS tr FROM bars),
m AS (SELECT symbol, date, i, CASE WHEN u > n AND u > 0 THEN u ELSE 0 END AS p, CASE WHEN n > u AND n > 0 THEN n ELSE 0 END AS q, tr FROM d WHERE i >= 0),
s AS (SELECT symbol, date, i, {', '.join(f'{sql_ewm_seeded(x, 1 / 14, 14)} AS {x}' for x in ('p', 'q', 'tr'))} FROM m),
di AS (SELECT symbol, date, i, 100 * p / tr AS pdi, 100 * q / tr AS mdi FROM s WHERE i >= 13 AND tr <> 0),
dx AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, 100 * abs(pdi - mdi) / (pdi + mdi) AS dx FROM di WHERE pdi + mdi <> 0),
a AS (SELECT symbol, date, {sql_ewm_seeded('dx', 1 / 14, 14)} AS adx FROM dx)
SELECT b.symbol, b.date, round(pdi, 6) AS plus_di, round(mdi, 6) AS minus_di, round(adx, 6) AS adx FROM bars b LEFT JOIN di ON b.symbol = di.symbol AND b.date = di.date LEFT JOIN a ON b.symbol = a.symbol AND b.date = a.date"""),
)
def _(spark, d):
    return rounded(ind.adx(trade_bars(spark, d)), ["symbol", "date", "plus_di", "minus_di", "adx"])


@query(
    "ind10_atr_three_ways",
    with_bars(f"""t AS (SELECT symbol, date, close, row_number() {_W} - 1 AS i, CASE WHEN lag(close) {_W} IS NULL THEN high - low ELSE {_TR} END AS tr FROM bars),
s AS (SELECT symbol, date, i - 1 AS i, tr FROM t WHERE i >= 1), e AS (SELECT symbol, date, {sql_ewm_seeded('tr', 1 / 14, 14)} AS a FROM s),
m AS (SELECT symbol, date, close, {_roll('avg', 'tr', 14)} AS mean, {sql_ewm('tr', 1 / 14)} AS wild FROM t)
SELECT m.symbol, m.date, round(mean, 6) AS atr_mean, round(e.a, 6) AS atr_seeded, round(wild, 6) AS atr_wilder, round(100 * e.a / close, 6) AS atr_pct
FROM m LEFT JOIN e ON m.symbol = e.symbol AND m.date = e.date"""),
)
def _(spark, d):
    df = ind.atr_wilder(ind.atr_seeded(ind.atr_mean(trade_bars(spark, d))))
    return rounded(df.withColumn("atr_pct", 100 * F.col("atr_seeded") / F.col("close")), ["symbol", "date", "atr_mean", "atr_seeded", "atr_wilder", "atr_pct"])


@query(
    "ind11_12_bands",
    with_bars(f"""{_N}, t AS (SELECT symbol, date, i - 1 AS i, tr FROM (SELECT symbol, date, i, {_TR} AS tr FROM n) WHERE i >= 1),
a AS (SELECT symbol, date, {sql_ewm_seeded('tr', 1 / 14, 14)} AS a FROM t),
b AS (SELECT symbol, date, close, {_roll('avg', 'close', 20)} AS m, {_roll('stddev_pop', 'close', 20)} AS s, {sql_ewm_seeded('close', 2 / 21, 20)} AS e FROM n)
SELECT b.symbol, b.date, round(m, 6) AS bb_mid, round(m + 2 * s, 6) AS bb_up, round(m - 2 * s, 6) AS bb_low, round((close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0), 5) AS bb_pct_b,
  round(((m + 2 * s) - (m - 2 * s)) / m, 6) AS bb_width, round(e, 6) AS kc_mid, round(e + 2 * a.a, 6) AS kc_up, round(e - 2 * a.a, 6) AS kc_low FROM b LEFT JOIN a ON b.symbol = a.symbol AND b.date = a.date"""),
)
def _(spark, d):
    df = ind.keltner(ind.bollinger(trade_bars(spark, d))).withColumn("bb_pct_b", F.round("bb_pct_b", 5))
    return rounded(df, ["symbol", "date", "bb_mid", "bb_up", "bb_low", "bb_pct_b", "bb_width", "kc_mid", "kc_up", "kc_low"])


@query(
    "ind13_14_15_volume",
    with_bars(f"""a AS (SELECT symbol, date, row_number() {_W} - 1 AS i, volume, CASE WHEN lag(close) {_W} IS NULL THEN 0 ELSE sign(close - lag(close) {_W}) * volume END AS s,
  CASE WHEN high > low THEN (2 * close - low - high) / (high - low) ELSE 0 END * volume AS mf, (close / lag(close) {_W} - 1) * volume AS rv FROM bars),
b AS (SELECT *, sum(CASE WHEN i = 0 THEN volume ELSE s END) {_W} AS obv, sum(s) {_W} AS obv_zero, sum(mf) {_W} AS ad, {_roll('sum', 'rv', 20)} / nullif({_roll('sum', 'volume', 20)}, 0) AS vwpm FROM a)
SELECT symbol, date, round(obv, 4) AS obv, round(obv_zero, 4) AS obv_zero, round(CASE WHEN i >= 19 THEN {sql_ewm('obv', 2 / 21)} END, 4) AS obv_ema, round(ad, 4) AS ad, round(vwpm, 6) AS vwpm FROM b"""),
)
def _(spark, d):
    df = ind.volume_weighted_move(ind.accumulation(ind.obv(trade_bars(spark, d)))).withColumn("vwpm", F.round("vwpm", 6))
    return rounded(df, ["symbol", "date", "obv", "obv_zero", "obv_ema", "ad"], 4).join(df.select("symbol", "date", "vwpm"), ["symbol", "date"])


@query(
    "ind16_sector_relative",
    with_bars(f"""x AS (SELECT *, avg(close) OVER (PARTITION BY date) AS lvl FROM bars), a AS (SELECT symbol, sector, date, {', '.join(f'close / lag(close, {n}) {_W} - 1 AS r{n}, lvl / lag(lvl, {n}) {_W} - 1 AS m{n}' for n in (5, 20))} FROM x),
b AS (SELECT symbol, date, {', '.join(f'r{n} - m{n} AS rel_market_{n}, r{n} - (sum(r{n}) OVER (PARTITION BY date, sector) - r{n}) / nullif(count(r{n}) OVER (PARTITION BY date, sector) - 1, 0) AS rel_sector_{n}' for n in (5, 20))} FROM a)
SELECT symbol, date, {', '.join(f'round(rel_{k}_{n}, 6) AS rel_{k}_{n}' for n in (5, 20) for k in ('sector', 'market'))}, round((rel_market_20 - {_roll('avg', 'rel_market_20', 60)}) / nullif({_roll('stddev_samp', 'rel_market_20', 60)}, 0), 5) AS rel_market_20_z FROM b"""),
)
def _(spark, d):
    names = [f"rel_{k}_{n}" for n in (5, 20) for k in ("sector", "market")]
    return ind.sector_features(trade_bars(spark, d)).select("symbol", "date", *[F.round(c, 6).alias(c) for c in names], F.round("rel_market_20_z", 5).alias("rel_market_20_z"))


@query(
    "ind17_long_term",
    with_bars(f"""a AS (SELECT symbol, date, close, {_roll('avg', 'close', 50)} AS a, {_roll('avg', 'close', 200)} AS b, close / lag(close, 252) {_W} - 1 AS ret_252 FROM bars)
SELECT symbol, date, round(ret_252, 6) AS ret_252, CASE WHEN b IS NOT NULL THEN CAST(close > b AS DOUBLE) END AS above_sma200, round(close / b - 1, 6) AS dist_sma200,
  CASE WHEN a / b - 1 > 0.001 THEN 1.0 WHEN a / b - 1 < -0.001 THEN -1.0 WHEN b IS NOT NULL THEN 0.0 END AS golden FROM a""".replace("THEN 1.0 ", "THEN CAST(1 AS DOUBLE) ").replace("THEN -1.0 ", "THEN CAST(-1 AS DOUBLE) ").replace("THEN 0.0 ", "THEN CAST(0 AS DOUBLE) ")),
)
def _(spark, d):
    return rounded(ind.long_term_features(trade_bars(spark, d)), ["symbol", "date", "ret_252", "above_sma200", "dist_sma200", "golden"])


_R14 = f"""{_RSI}, m AS (SELECT symbol, date, {sql_ewm_seeded('u', 1 / 14, 14)} AS u, {sql_ewm_seeded('n', 1 / 14, 14)} AS n FROM g),
{_N}, e AS (SELECT symbol, date, close, {sql_ewm_seeded('close', 2 / 21, 20)} AS e20, {sql_ewm_seeded('close', 2 / 51, 50)} AS e50 FROM n),
r AS (SELECT e.symbol, e.date, close, e20, e50, {_rsi_sql('u', 'n')} AS rsi FROM e LEFT JOIN m ON e.symbol = m.symbol AND e.date = m.date)"""
_B10 = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


def _z(x: str, n: int) -> str:
    return f"({x} - {_roll('avg', x, n)}) / nullif({_roll('stddev_samp', x, n)}, 0)"


@query(
    "ind18_rsi_family",
    with_bars(f"""{_R14}, x AS (SELECT *, CASE WHEN count(close) {_B10} = 10 THEN min(close) {_B10} END AS lc, CASE WHEN count(close) {_B10} = 10 THEN max(close) {_B10} END AS hc,
  CASE WHEN count(rsi) {_B10} = 10 THEN min(rsi) {_B10} END AS lr, CASE WHEN count(rsi) {_B10} = 10 THEN max(rsi) {_B10} END AS hr FROM r)
SELECT symbol, date, round(rsi - lag(rsi, 1) {_W}, 5) AS rsi_d1, round(rsi - lag(rsi, 5) {_W}, 5) AS rsi_d5, round({_z('rsi', 30)}, 5) AS rsi_z30, round({_z('rsi', 60)}, 5) AS rsi_z60, CAST(CASE WHEN {_roll('max', 'rsi', 20)} <= 60 THEN -1 WHEN {_roll('min', 'rsi', 20)} >= 40 THEN 1 WHEN {_roll('min', 'rsi', 20)} IS NOT NULL THEN 0 END AS DOUBLE) AS rsi_range,
  CAST(rsi > 60 AS DOUBLE) AS rsi_above60, CAST(rsi < 40 AS DOUBLE) AS rsi_below40, round((rsi - {_roll('min', 'rsi', 10)}) / nullif({_roll('max', 'rsi', 10)} - {_roll('min', 'rsi', 10)}, 0), 5) AS rsi_place,
  CAST(coalesce(close < lc AND rsi > lr, false) AS DOUBLE) AS rsi_bull_div, CAST(coalesce(close > hc AND rsi < hr, false) AS DOUBLE) AS rsi_bear_div, round(close / e20 - 1, 5) AS dist_ema20, round(close / e50 - 1, 5) AS dist_ema50 FROM x"""),
)
def _(spark, d):
    names = ["rsi_d1", "rsi_d5", "rsi_z30", "rsi_z60", "rsi_range", "rsi_above60", "rsi_below40", "rsi_place", "rsi_bull_div", "rsi_bear_div", "dist_ema20", "dist_ema50"]
    return rounded(ind.rsi_features(trade_bars(spark, d)), ["symbol", "date", *names], 5)


@query(
    "ind21_baseline_inputs",
    with_bars(f"""{_N}, {_RSI}, m AS (SELECT symbol, date, i, {sql_ewm('u', 1 / 14)} AS u, {sql_ewm('n', 1 / 14)} AS n FROM g),
e AS (SELECT symbol, date, i, close, volume, {sql_ewm_weighted('close', 2 / 13)} AS a, {sql_ewm_weighted('close', 2 / 27)} AS b, ln(close) - ln(lag(close) {_W}) AS lr, CASE WHEN i = 0 THEN high - low ELSE {_TR} END AS tr,
  CASE WHEN i = 0 THEN 0 ELSE sign(close - lag(close) {_W}) * volume END AS s FROM n),
f AS (SELECT *, {_roll('avg', 'tr', 14)} AS atr, 4 * {_roll('stddev_samp', 'close', 20)} / nullif({_roll('avg', 'close', 20)}, 0) AS width, {_roll('avg', 'close', 14)} AS sma, sum(s) {_W} AS obv, lead(lr) {_W} AS y FROM e)
SELECT f.symbol, f.date, round(lr, 5) AS b_ret, round(CASE WHEN m.i >= 13 THEN {_rsi_sql('u', 'n')} END, 5) AS b_rsi, round(CASE WHEN f.i >= 25 THEN a - b END, 5) AS b_macd, round(atr, 5) AS b_atr, round(width, 5) AS b_width, round(obv, 5) AS b_obv, round(sma, 5) AS b_sma, round(volume, 5) AS b_volume, round(y, 5) AS b_y
FROM f LEFT JOIN m ON f.symbol = m.symbol AND f.date = m.date"""),
)
def _(spark, d):
    return rounded(ind.baseline_inputs(trade_bars(spark, d)), ["symbol", "date", "b_ret", "b_rsi", "b_macd", "b_atr", "b_width", "b_obv", "b_sma", "b_volume", "b_y"], 5)


@query(
    "ind21_scaled_windows",
    with_bars(f"""a AS (SELECT symbol, date, close / lag(close) {_W} - 1 AS x, (high - low) / close AS y FROM bars),
s AS (SELECT symbol, date, {', '.join(f"({c} - min({c}) FILTER (WHERE date < DATE '1999-01-01') OVER (PARTITION BY symbol)) / nullif(max({c}) FILTER (WHERE date < DATE '1999-01-01') OVER (PARTITION BY symbol) - min({c}) FILTER (WHERE date < DATE '1999-01-01') OVER (PARTITION BY symbol), 0) AS {c}" for c in 'xy')} FROM a),
v AS (SELECT symbol, date, x, y, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END AS ok FROM s)
SELECT symbol, date, CASE WHEN count(ok) {_frame(60)} = 60 THEN 60 END AS n_rows, round(CASE WHEN count(ok) {_frame(60)} = 60 THEN sum(x) {_frame(60)} END, 5) AS sum_x, round(CASE WHEN count(ok) {_frame(60)} = 60 THEN sum(y) {_frame(60)} END, 5) AS sum_y FROM v"""),
)
def _(spark, d):
    df = trade_bars(spark, d).withColumn("x", r.change(F.col("close"))).withColumn("y", (F.col("high") - F.col("low")) / F.col("close"))
    df = ind.windows_of(ind.minmax_scaled(df, ["x", "y"], F.col("date") < "1999-01-01"), ["x", "y"])
    total = lambda k: F.round(F.aggregate("window", F.lit(0.0), lambda a, v: a + v[k]), 5)
    return df.select("symbol", "date", F.when(F.col("window").isNotNull(), F.size("window")).alias("n_rows"), total(0).alias("sum_x"), total(1).alias("sum_y"))


@query(
    "ind22_kama",
    recursive(with_bars(f"""a AS (SELECT symbol, date, close, row_number() {_W} AS i, count(*) OVER (PARTITION BY symbol) AS n, abs(close - lag(close, 10) {_W}) AS d, abs(close - lag(close) {_W}) AS m FROM bars),
e AS MATERIALIZED (SELECT *, d / nullif({_roll('sum', 'm', 10)}, 0) AS er FROM a),
k(symbol, i, kama) AS (SELECT symbol, i, close FROM e WHERE i = 10 AND n > 10
  UNION ALL SELECT e.symbol, e.i, k.kama + pow(coalesce(er, 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) * (close - k.kama) FROM k JOIN e ON e.symbol = k.symbol AND e.i = k.i + 1)
SELECT e.symbol, e.date, round(er, 6) AS er, round(kama, 6) AS kama, round(kama - lag(kama) OVER (PARTITION BY e.symbol ORDER BY e.date), 6) AS kama_slope FROM e LEFT JOIN k ON e.symbol = k.symbol AND e.i = k.i""")),
)
def _(spark, d):
    return rounded(ind.kama(trade_bars(spark, d)), ["symbol", "date", "er", "kama", "kama_slope"])


@query(
    "ind22_efficiency_ratio",
    with_bars(f"""a AS (SELECT symbol, date, close, abs(close - lag(close) {_W}) AS m FROM bars)
SELECT symbol, date, round(abs(close - lag(close, 10) {_W}) / nullif({_roll('sum', 'm', 10)}, 0), 6) AS er FROM a"""),
)
def _(spark, d):
    return rounded(ind.efficiency(trade_bars(spark, d)), ["symbol", "date", "er"])


@query(
    "ind23_breadth_seasonality",
    with_bars(f"""a AS (SELECT symbol, date, volume, row_number() {_W} AS i, close / lag(close) {_W} - 1 AS x, {_roll('avg', 'volume', 20)} AS m FROM bars),
b AS (SELECT symbol, date, i, CAST(coalesce(volume > m, false) AS DOUBLE) AS above, avg(x) OVER (PARTITION BY symbol, day(date) ORDER BY date) AS dm, avg(x) OVER (PARTITION BY symbol, month(date) ORDER BY date) AS mm FROM a)
SELECT symbol, date, round(avg(above) {_frame(20)}, 6) AS vol_breadth, round(CASE WHEN i >= 30 THEN (coalesce(dm, 0) + coalesce(mm, 0)) / 2 ELSE 0 END, 6) AS season FROM b"""),
)
def _(spark, d):
    return rounded(ind.seasonality(ind.volume_breadth(trade_bars(spark, d))), ["symbol", "date", "vol_breadth", "season"])


@query("ind24_composite_scores")
def _(spark, d):
    return rounded(ind.next_candle_score(trade_bars(spark, d)), ["symbol", "date", "score2", "score3"])


@query(
    "win01_02_08_12_rolling",
    with_bars(f"""a AS (SELECT *, close / lag(close) {_W} - 1 AS x FROM bars)
SELECT symbol, date, round(lag(close, 2) {_W}, 6) AS lag2, round(lead(close, 3) {_W}, 6) AS lead3, round(x, 6) AS ret1, round({_roll('avg', 'x', 20)}, 6) AS mean20, round({_roll('stddev_samp', 'x', 20)}, 6) AS sd20,
  round({_roll('min', 'close', 20, 5)}, 6) AS min20, round({_roll('max', 'close', 20, 5)}, 6) AS max20, round({_roll('sum', 'volume', 10)}, 6) AS sum10, round({_z('x', 60)}, 5) AS z60, round(sum(volume) {_W}, 4) AS cumsum, round(max(close) {_W}, 6) AS cummax, count(x) {_W} AS cumcount FROM a"""),
)
def _(spark, d):
    c, v = F.col("close"), F.col("volume")
    df = trade_bars(spark, d).withColumn("x", r.change(c))
    x = F.col("x")
    return df.select(
        "symbol", "date", F.round(F.lag(c, 2).over(r.series()), 6).alias("lag2"), F.round(F.lead(c, 3).over(r.series()), 6).alias("lead3"), F.round(x, 6).alias("ret1"), F.round(r.rolling(F.avg, x, 20), 6).alias("mean20"),
        F.round(r.rolling(F.stddev_samp, x, 20), 6).alias("sd20"), F.round(r.rolling(F.min, c, 20, 5), 6).alias("min20"), F.round(r.rolling(F.max, c, 20, 5), 6).alias("max20"), F.round(r.rolling(F.sum, v, 10), 6).alias("sum10"),
        F.round(r.zscore(x, 60), 5).alias("z60"), F.round(F.sum(v).over(r.so_far()), 4).alias("cumsum"), F.round(F.max(c).over(r.so_far()), 6).alias("cummax"), F.count(x).over(r.so_far()).alias("cumcount"),
    )


@query(
    "win03_06_median_and_rank",
    with_bars(f"""a AS (SELECT symbol, date, close, list(close) {_frame(60)} AS l FROM bars)
SELECT symbol, date, round(CASE WHEN len(l) >= 10 THEN list_aggregate(l, 'quantile_cont', 0.5) END, 6) AS med, round(CASE WHEN len(l) >= 30 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2.0) / len(l) END, 6) AS rnk FROM a"""),
)
def _(spark, d):
    c = F.col("close")
    df = rolling_order(trade_bars(spark, d).select("symbol", "date", "close"), {"med": Rolling("median", c, 60, 10), "rnk": Rolling("rank", c, 60, 30)})
    return rounded(df, ["symbol", "date", "med", "rnk"])


@query(
    "win04_05_07_skew_beta_line",
    with_bars(f"""a AS (SELECT symbol, date, close, close / lag(close) {_W} - 1 AS x FROM bars), m AS (SELECT *, avg(x) OVER (PARTITION BY date) AS mk FROM a)
SELECT symbol, date, round({_roll('skewness', 'x', 60)}, 4) AS skew60, round(CASE WHEN count(x) {_frame(60)} >= 60 THEN covar_samp(x, mk) {_frame(60)} / nullif(var_samp(CASE WHEN x IS NOT NULL THEN mk END) {_frame(60)}, 0) END, 5) AS beta60,
  round(CASE WHEN count(close) OVER f = 10 THEN regr_slope(close, k) OVER f END, 4) AS slope10, round(CASE WHEN count(close) OVER f = 10 THEN regr_intercept(close, k) OVER f + regr_slope(close, k) OVER f * k END, 2) AS line10
FROM (SELECT *, row_number() {_W} AS k FROM m) WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""),
)
def _(spark, d):
    df = trade_bars(spark, d).withColumn("x", r.change(F.col("close"))).withColumn("mk", F.avg("x").over(Window.partitionBy("date")))
    df = df.withColumn("i", F.row_number().over(r.series()))
    slope, value = r.rolling_line(F.col("close"), 10, F.col("i"))
    return df.select("symbol", "date", F.round(r.rolling_skew(F.col("x"), 60), 4).alias("skew60"), F.round(r.rolling_beta(F.col("x"), F.col("mk"), 60), 5).alias("beta60"), F.round(slope, 4).alias("slope10"), F.round(value, 2).alias("line10"))


@query(
    "win09_10_11_extremes_pivots",
    with_bars("""SELECT symbol, date, round(max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 6) AS next_max, round(CASE WHEN count(close) OVER b = 10 THEN min(close) OVER b END, 6) AS prior_min,
  coalesce(count(high) OVER p = 11 AND high = max(high) OVER p, false) AS pivot_high, coalesce(count(low) OVER p = 11 AND low = min(low) OVER p, false) AS pivot_low FROM bars
WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"""),
)
def _(spark, d):
    c = F.col("close")
    return trade_bars(spark, d).select(
        "symbol", "date", F.round(r.extreme_after(F.max, c, 10), 6).alias("next_max"), F.round(r.extreme_before(F.min, c, 10), 6).alias("prior_min"),
        r.is_pivot(F.col("high"), 5, True).alias("pivot_high"), r.is_pivot(F.col("low"), 5, False).alias("pivot_low"),
    )


@query(
    "win13_product_after",
    with_bars("SELECT symbol, date, round(coalesce(product(CASE WHEN day(date) = 1 THEN 1.01 ELSE 1.0 END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0), 6) AS factor FROM bars"),
)
def _(spark, d):
    x = F.when(F.dayofmonth("date") == 1, 1.01).otherwise(1.0)
    return trade_bars(spark, d).select("symbol", "date", F.round(r.product_after(x), 6).alias("factor"))


@query(
    "win14_forward_fill",
    with_bars(f"""a AS (SELECT symbol, date, CASE WHEN close > open THEN close END AS x FROM bars)
SELECT symbol, date, round(last_value(x IGNORE NULLS) {_W}, 6) AS ffill, round(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS ffill5 FROM a"""),
)
def _(spark, d):
    df = trade_bars(spark, d).withColumn("x", F.when(F.col("close") > F.col("open"), F.col("close")))
    return df.select("symbol", "date", F.round(r.filled(F.col("x")), 6).alias("ffill"), F.round(r.filled(F.col("x"), 5), 6).alias("ffill5"))


@query(
    "win15_ewm_modes",
    with_bars(f"{_N} SELECT symbol, date, round({sql_ewm('close', 0.1)}, 6) AS recursive, round({sql_ewm_weighted('close', 0.1)}, 6) AS weighted, round({sql_ewm_seeded('close', 0.1, 12)}, 6) AS seeded FROM n"),
)
def _(spark, d):
    df = trade_bars(spark, d)
    for mode in ("recursive", "weighted", "seeded"):
        df = ewm(df, F.col("close"), mode, 0.1, mode, seed=12)
    return rounded(df, ["symbol", "date", "recursive", "weighted", "seeded"])


@query(
    "win16_17_cross_section",
    with_bars(f"""a AS (SELECT symbol, sector, date, close / lag(close, 5) {_W} - 1 AS x FROM bars), b AS (SELECT * FROM a WHERE x IS NOT NULL)
SELECT symbol, date, round((rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0) / count(*) OVER (PARTITION BY date), 6) AS rk, round(x - avg(x) OVER (PARTITION BY date), 6) AS demeaned,
  round((x - avg(x) OVER (PARTITION BY date)) / nullif(stddev_samp(x) OVER (PARTITION BY date), 0), 4) AS z, round(quantile_cont(x, 0.5) OVER (PARTITION BY date), 6) AS med, round(avg(x) OVER (PARTITION BY date, sector), 6) AS sector_mean FROM b"""),
)
def _(spark, d):
    df = trade_bars(spark, d).withColumn("x", r.change(F.col("close"), 5)).where("x is not null")
    x = F.col("x")
    return df.select(
        "symbol", "date", F.round(r.section_rank(x), 6).alias("rk"), F.round(x - F.avg(x).over(Window.partitionBy("date")), 6).alias("demeaned"), F.round(r.section_zscore(x), 4).alias("z"),
        F.round(r.section_median(x), 6).alias("med"), F.round(F.avg(x).over(Window.partitionBy("date", "sector")), 6).alias("sector_mean"),
    )


@query(
    "win18_19_20_runs_segments",
    with_bars(f"""a AS (SELECT symbol, date, floor(close / 200) AS k, row_number() {_W} AS i FROM bars), b AS (SELECT *, sum(CASE WHEN k = lag(k) {_W} THEN 0 ELSE 1 END) {_W} AS run FROM (SELECT *, CASE WHEN k = lag(k) {_W} THEN 1 END AS same FROM a))
SELECT symbol, run, min(date) AS start, max(date) AS stop, count(*) AS n FROM b GROUP BY symbol, run HAVING count(*) >= 3""".replace("sum(CASE WHEN k = lag(k) OVER (PARTITION BY symbol ORDER BY date) THEN 0 ELSE 1 END)", "sum(CASE WHEN same = 1 THEN 0 ELSE 1 END)")),
)
def _(spark, d):
    df = trade_bars(spark, d).withColumn("k", F.floor(F.col("close") / 200)).withColumn("same", F.col("k") == F.lag("k").over(r.series()))
    df = df.withColumn("run", r.run_id(F.col("same")))
    return df.groupBy("symbol", "run").agg(F.min("date").alias("start"), F.max("date").alias("stop"), F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(
    "win21_22_grid_and_blocks",
    with_bars("""d AS (SELECT DISTINCT date FROM bars) SELECT date, ntile(10) OVER (ORDER BY date) AS block, (row_number() OVER (ORDER BY date) - 1 >= 2 AND (row_number() OVER (ORDER BY date) - 3) % 4 = 0) AS rebalance FROM d"""),
)
def _(spark, d):
    dates = trade_bars(spark, d).select("date").distinct()  # a few thousand dates: one small sort
    spec = Window.orderBy("date")
    return dates.select("date", F.ntile(10).over(spec).alias("block"), r.every(4, 2, spec).alias("rebalance"))
