"""Queries of signals, backtests, portfolios, statistics, patterns and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..functions.rolling import change, rolling, series
from ..operators import backtest as bt
from ..operators import boosting, calendar, crosssection, labels, models, paths, patterns, signals, splits, stats
from ..operators import indicators as ind
from ..sources.bars import trade_bars
from .base import ORACLE_SQL, query, recursive, rounded, sql_ewm, sql_ewm_seeded, with_bars
from .indicators import _B10, _K, _N, _R14, _RSI, _W, _frame, _roll, _rsi_sql, _z
from .market import _LABELS, fold_ranges

_RSI_SIGNAL = f"""{_RSI}, m AS (SELECT symbol, date, i, {sql_ewm('u', 1 / 14)} AS u, {sql_ewm('n', 1 / 14)} AS n FROM g),
rr AS (SELECT b.*, CASE WHEN i >= 13 THEN {_rsi_sql('u', 'n')} END AS rsi FROM bars b LEFT JOIN m ON b.symbol = m.symbol AND b.date = m.date)"""


def _state(enter: str, leave: str, known: str) -> str:
    return f"coalesce(last_value(CASE WHEN NOT ({known}) THEN 0 WHEN {enter} THEN 1 WHEN {leave} THEN 0 END IGNORE NULLS) {_W}, 0)"


def _backtest_sql(signal: str = "signal", source: str = "sg", part: str = "symbol") -> str:
    """Tables bp and eq after ``source`` (bars with a signal): a bar's position and returns."""
    w = f"OVER (PARTITION BY {part} ORDER BY date)"
    return f"""bw AS (SELECT *, coalesce(lag({signal}) {w}, 0) AS want, NOT (open = high AND high = low AND low = close AND volume = 0) AS can FROM {source}),
bp AS (SELECT *, coalesce(last_value(CASE WHEN can THEN want END IGNORE NULLS) {w}, 0) AS position, lead(date) {w} IS NULL AS is_last FROM bw),
bm AS (SELECT *, coalesce(lag(position) {w}, 0) AS pp, lag(CASE WHEN position = 1 THEN close END) {w} AS pm FROM bp),
br AS (SELECT *, CASE WHEN position = 1 AND pp = 0 THEN close / open - 1 WHEN position = 1 THEN coalesce(close / pm - 1, 0) WHEN pp = 1 THEN open / pm - 1 ELSE 0 END AS gross, (position = 0 AND pp = 1) OR (is_last AND position = 1) AS ex FROM bm),
eq AS (SELECT *, CASE WHEN ex THEN (1 + gross) * (1 - 0.0035) - 1 ELSE gross END AS net FROM br)"""


def _metrics_sql(part: str = "symbol", source: str = "eq", ret: str = "net", exposure: bool = True) -> str:
    return f"""SELECT {part}, round(ln(max(fq)), 5) AS log_total, round(CASE WHEN max(fq) > 0 THEN ln(max(fq)) / (date_diff('day', min(date), max(date)) / 365.25) END, 5) AS log_cagr, round(stddev_samp({ret}) * sqrt(252), 5) AS vol,
  round(avg({ret}) * 252 / nullif(stddev_samp({ret}) * sqrt(252), 0), 5) AS sharpe, round(min(dd), 5) AS max_dd, count({ret}) AS n{', round(avg(position), 5) AS exposure' if exposure else ''}
FROM (SELECT *, last_value(q) OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fq, q / greatest(max(q) OVER (PARTITION BY {part} ORDER BY date), 1.0) - 1 AS dd
  FROM (SELECT *, product(1 + {ret}) OVER (PARTITION BY {part} ORDER BY date) AS q FROM {source})) GROUP BY {part}"""


def _told(m, keys=("symbol",), exposure=True):
    names = [F.round(F.log(1 + F.col("total")), 5).alias("log_total"), F.round(F.log(1 + F.col("cagr")), 5).alias("log_cagr"), *[F.round(c, 5).alias(c) for c in ("vol", "sharpe", "max_dd")], "n"]
    return m.select(*keys, *names, *([F.round("exposure", 5).alias("exposure")] if exposure else []))


def rsi_panel(spark, d):
    """The flagship: what buying RSI under 45 and selling over 55 earned after costs, by symbol (this panel's RSI hardly leaves 40 to 60)."""
    df = ind.rsi(trade_bars(spark, d))
    df = df.withColumn("signal", signals.hysteresis(F.col("rsi") < 45, F.col("rsi") > 55, F.col("rsi").isNotNull()))
    return bt.backtest(df)


_RSI_SG = f"{_RSI_SIGNAL}, sg AS (SELECT *, {_state('rsi < 45', 'rsi > 55', 'rsi IS NOT NULL')} AS signal FROM rr)"


@query("bkt01_agg09_rsi_rule", with_bars(f"{_RSI_SG}, {_backtest_sql()} {_metrics_sql()}"))
def flagship(spark, d):
    return _told(bt.metrics(rsi_panel(spark, d)))


@query("bkt01_positions", with_bars(f"{_RSI_SG}, {_backtest_sql()} SELECT symbol, date, position, round(gross, 6) AS gross_ret, round(net, 6) AS net_ret, ex AS exit FROM eq"))
def _(spark, d):
    return rounded(rsi_panel(spark, d), ["symbol", "date", "position", "gross_ret", "net_ret", "exit"])


@query("bkt12_trades", with_bars(f"""{_RSI_SG}, {_backtest_sql()}, tr AS (SELECT *, sum(CASE WHEN position = 1 AND pp = 0 THEN 1 ELSE 0 END) {_W} AS trade FROM eq)
SELECT symbol, trade, min(date) AS entry_date, round(arg_min(open, date), 6) AS entry_price, max(date) FILTER (WHERE ex) AS exit_date, round(max(CASE WHEN position = 1 THEN close ELSE open END) FILTER (WHERE ex), 6) AS exit_price, CAST(sum(position) AS BIGINT) AS bars_held,
  round(ln(product(1 + gross)), 5) AS log_gross, bool_or(ex AND position = 1) AS forced FROM tr WHERE position = 1 OR ex GROUP BY symbol, trade"""))
def _(spark, d):
    t = bt.trades(rsi_panel(spark, d))
    return t.select("symbol", "trade", "entry_date", F.round("entry_price", 6).alias("entry_price"), "exit_date", F.round("exit_price", 6).alias("exit_price"), "bars_held", F.round(F.log(1 + F.col("gross_return")), 5).alias("log_gross"), "forced")


@query("bkt02_buy_and_hold", with_bars(f"sg AS (SELECT *, 1 AS signal FROM bars), {_backtest_sql()} {_metrics_sql()}"))
def _(spark, d):
    return _told(bt.metrics(bt.buy_and_hold(trade_bars(spark, d))))


@query("agg08_equal_weight", with_bars(f"{_RSI_SG}, {_backtest_sql()} SELECT date, round(avg(net), 6) AS ret, count(net) AS names FROM eq GROUP BY date"))
def _(spark, d):
    return rounded(bt.equal_weight(rsi_panel(spark, d)), ["date", "ret", "names"])


_SIMPLE = f"""e AS (SELECT n.*, {sql_ewm_seeded('close', 2 / 21, 20)} AS e20, {sql_ewm_seeded('close', 2 / 51, 50)} AS e50 FROM n),
p AS (SELECT symbol, date, close, e20, e50, close / lag(close, 252) {_W} - 1 AS mom, (close / lag(close) {_W} - 1) * volume AS rv, volume FROM e)"""


@query("sig01_05_simple_rules", with_bars(f"{_N}, {_SIMPLE} SELECT symbol, date, 1 AS sig_hold, CAST(coalesce(mom > 0, false) AS INTEGER) AS sig_mom252, CAST(coalesce(e20 > e50, false) AS INTEGER) AS sig_ema_cross, CAST(coalesce({_roll('sum', 'rv', 20)} / nullif({_roll('sum', 'volume', 20)}, 0) > 0, false) AS INTEGER) AS sig_vwpm FROM p"))
def _(spark, d):
    return signals.simple_rules(trade_bars(spark, d)).select("symbol", "date", "sig_hold", "sig_mom252", "sig_ema_cross", "sig_vwpm")


@query("sig02_03_oscillator_rules", with_bars(f"{_R14}, rr AS (SELECT * FROM r) SELECT symbol, date, {_state('rsi < 30', 'rsi > 50', 'rsi IS NOT NULL')} AS sig_rsi_30_50, {_state('rsi < 30', 'rsi > 70', 'rsi IS NOT NULL')} AS sig_rsi_30_70, {_state('rsi > 60', 'rsi < 40', 'rsi IS NOT NULL')} AS sig_rsi_60_40 FROM rr"))
def _(spark, d):
    return signals.oscillator_rules(trade_bars(spark, d)).select("symbol", "date", "sig_rsi_30_50", "sig_rsi_30_70", "sig_rsi_60_40")


@query("sig03_all_oscillators", with_bars(f"""c AS (SELECT symbol, date, close, {_K} AS k0, (high + low + close) / 3 AS tp, CASE WHEN {_roll('max', 'high', 14)} > {_roll('min', 'low', 14)} THEN -100 * ({_roll('max', 'high', 14)} - close) / ({_roll('max', 'high', 14)} - {_roll('min', 'low', 14)}) END AS wr FROM bars),
l AS (SELECT symbol, date, {_roll('avg', 'k0', 3)} AS k, wr, tp, {_roll('avg', 'tp', 20)} AS m, list(tp) {_frame(20)} AS w FROM c),
o AS (SELECT symbol, date, k, wr, CASE WHEN m IS NOT NULL AND list_sum(list_transform(w, lambda x: abs(x - m))) > 0 THEN (tp - m) / (0.015 * list_sum(list_transform(w, lambda x: abs(x - m))) / 20) END AS cci FROM l)
SELECT symbol, date, {_state('k < 20', 'k > 50', 'k IS NOT NULL')} AS sig_stoch_20_50, {_state('cci < -100', 'cci > 0', 'cci IS NOT NULL')} AS sig_cci_100_0, {_state('wr < -80', 'wr > -50', 'wr IS NOT NULL')} AS sig_willr_80_50 FROM o"""))
def _(spark, d):
    return signals.oscillator_rules(trade_bars(spark, d)).select("symbol", "date", "sig_stoch_20_50", "sig_cci_100_0", "sig_willr_80_50")


@query("sig04_band_rules", with_bars(f"""b AS (SELECT symbol, date, close, {_roll('avg', 'close', 20)} AS m, {_roll('avg', 'close', 20)} - 2 * {_roll('stddev_pop', 'close', 20)} AS lo FROM bars)
SELECT symbol, date, {_state('close < lo', 'close > m', 'm IS NOT NULL')} AS sig_bb FROM b"""))
def _(spark, d):
    return signals.band_rules(trade_bars(spark, d)).select("symbol", "date", "sig_bb")


@query("sig06_rsi_rules", with_bars(f"""{_R14}, rr AS (SELECT * FROM r) SELECT symbol, date, CAST(coalesce(rsi > 50, false) AS INTEGER) AS sig_rsi50, CAST(coalesce(rsi >= 40, false) AS INTEGER) AS sig_rsi40, CAST(coalesce(rsi - lag(rsi, 5) {_W} > 0 AND rsi > 50, false) AS INTEGER) AS sig_velocity, CAST(coalesce({_z('rsi', 60)} > 0, false) AS INTEGER) AS sig_rsi_z FROM rr"""))
def _(spark, d):
    return signals.rsi_rules(trade_bars(spark, d)).select("symbol", "date", "sig_rsi50", "sig_rsi40", "sig_velocity", "sig_rsi_z")


@query("sig06_gated_rules", with_bars(f"""{_R14}, b AS (SELECT *, {_state('rsi > 60', 'rsi < 40', 'rsi IS NOT NULL')} AS b, coalesce(close > e20, false) AS o20, coalesce(e20 > e50, false) AS o50 FROM r)
SELECT symbol, date, CAST(b = 1 AND o20 AS INTEGER) AS sig_rsi_ema20, CAST(b = 1 AND o20 AND o50 AS INTEGER) AS sig_rsi_ema50, CAST(o20 AS INTEGER) AS sig_ema20 FROM b"""))
def _(spark, d):
    return signals.rsi_rules(trade_bars(spark, d)).select("symbol", "date", "sig_rsi_ema20", "sig_rsi_ema50", "sig_ema20")


def _machine_sql(source: str) -> str:
    """Tables cd, st after ``source`` (symbol, date, known, enter, leave): the states of a machine whose enter and leave can both hold, bar by bar."""
    return f"""cd AS MATERIALIZED (SELECT symbol, date, row_number() {_W} AS i, coalesce(known, false) AS k, coalesce(enter, false) AS e, coalesce(leave, false) AS x FROM {source}),
st(symbol, i, s) AS (SELECT symbol, i, CAST(k AND e AS INTEGER) FROM cd WHERE i = 1
  UNION ALL SELECT cd.symbol, cd.i, CASE WHEN NOT k THEN 0 WHEN st.s = 1 THEN CAST(NOT x AS INTEGER) ELSE CAST(e AS INTEGER) END FROM st JOIN cd ON cd.symbol = st.symbol AND cd.i = st.i + 1)"""


def _turns_sql(source: str) -> str:
    """Table tn after ``source`` (symbol, date, rsi, ...): m_top and w_bottom by lists of turning points."""
    rule = lambda ends, near, less, out: f"coalesce(i > 27 AND {ends}[-2].v {less} {near} AND {ends}[-1].v {less} {near} AND {out}, false)"
    between = lambda ends, others, best: f"list_aggregate(list_transform(list_filter({others}, lambda p: p.n > {ends}[-2].n AND p.n < {ends}[-1].n), lambda p: p.v), '{best}')"
    top = rule("his", 60, ">", f"his[-1].v <= his[-2].v + 1 AND rsi < {between('his', 'los', 'min')}")
    bottom = rule("los", 40, "<", f"los[-1].v >= los[-2].v - 1 AND rsi > {between('los', 'his', 'max')}")
    return f"""tp AS (SELECT *, row_number() {_W} AS i, rsi >= lag(rsi) {_W} AND rsi >= lead(rsi) {_W} AS hi, rsi <= lag(rsi) {_W} AND rsi <= lead(rsi) {_W} AS lo FROM {source}),
tl AS (SELECT *, list({{'n': i, 'v': rsi}}) FILTER (WHERE hi) OVER f AS his, list({{'n': i, 'v': rsi}}) FILTER (WHERE lo) OVER f AS los FROM tp WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 25 PRECEDING AND 2 PRECEDING)),
tn AS (SELECT *, {top} AS m_top, {bottom} AS w_bottom FROM tl)"""


@query("sig07_divergence", recursive(with_bars(f"""{_R14}, dv AS (SELECT symbol, date, rsi IS NOT NULL AS known, rsi > 60 AS leave,
  CASE WHEN count(close) {_B10} = 10 THEN close < min(close) {_B10} END AND CASE WHEN count(rsi) {_B10} = 10 THEN rsi > min(rsi) {_B10} END AS enter FROM r),
{_machine_sql('dv')} SELECT cd.symbol, cd.date, st.s AS sig_div FROM cd JOIN st ON cd.symbol = st.symbol AND cd.i = st.i""")))
def _(spark, d):
    return signals.divergence_rule(trade_bars(spark, d)).select("symbol", "date", "sig_div")


@query("sig08_configurable", recursive(with_bars(f"""{_R14}, {_turns_sql('r')}, cf AS (SELECT symbol, date, rsi IS NOT NULL AS known, coalesce(rsi < 40 OR rsi > 80, false) OR m_top AS leave, (coalesce(rsi > 60, false) OR w_bottom) AND close > e20 AS enter FROM tn),
{_machine_sql('cf')} SELECT cd.symbol, cd.date, st.s AS sig_conf FROM cd JOIN st ON cd.symbol = st.symbol AND cd.i = st.i""")))
def _(spark, d):
    return signals.configurable_rule(trade_bars(spark, d), 60.0, 40.0, 80.0, entry_on_w=True, exit_on_m=True, above_ema=20).select("symbol", "date", "sig_conf")


@query("sig09_double_tops", with_bars(f"{_RSI_SIGNAL}, {_turns_sql('rr')} SELECT symbol, date, m_top, w_bottom FROM tn WHERE m_top OR w_bottom"))
def _(spark, d):
    return signals.double_tops(ind.rsi(trade_bars(spark, d)), "rsi").where("m_top or w_bottom").select("symbol", "date", "m_top", "w_bottom")


@query("sig11_bkt09_score_strategy")
def _(spark, d):
    df = ind.next_candle_score(trade_bars(spark, d)).withColumn("p", F.when(F.row_number().over(series()) > 30, signals.score_positions(F.col("score3"), 0.1, True)).otherwise(0))
    return rounded(bt.close_to_close(df, "p"), ["symbol", "n_active", "hit_rate", "mean_ret", "sharpe"], 5)


@query("bkt09_close_to_close", with_bars(f"""p AS (SELECT symbol, date, CASE WHEN close > open THEN 1 ELSE 0 END * (lead(close) {_W} / close - 1) AS r, close > open AS on_ FROM bars)
SELECT symbol, count(*) AS n_active, round(avg(CAST(r > 0 AS DOUBLE)), 5) AS hit_rate, round(avg(r), 5) AS mean_ret, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS sharpe FROM p WHERE on_ AND r IS NOT NULL GROUP BY symbol"""))
def _(spark, d):
    df = trade_bars(spark, d).withColumn("p", (F.col("close") > F.col("open")).cast("int"))
    return rounded(bt.close_to_close(df, "p"), ["symbol", "n_active", "hit_rate", "mean_ret", "sharpe"], 5)


GRID = [(f"rsi{n}_e{e}_{a:g}_{f:g}_{k}", a, f, n, e, k) for n in (7, 14) for e in (20, 50) for a in (50.0, 60.0) for f in (40.0,) for k in (True, False)]


@query(
    "bkt10_sig10_joi17_agg29_grid",
    with_bars(
        f"{_RSI}, mm AS (SELECT symbol, date, {', '.join(f'{sql_ewm_seeded(x, 1 / n, n)} AS {x}{n}' for n in (7, 14) for x in 'un')} FROM g), {_N}, e AS (SELECT symbol, date, open, high, low, close, volume, {', '.join(f'{sql_ewm_seeded('close', 2 / (k + 1), k)} AS e{k}' for k in (20, 50))} FROM n), "
        f"j AS (SELECT e.*, {', '.join(f'{_rsi_sql(f'u{n}', f'n{n}')} AS r{n}' for n in (7, 14))} FROM e LEFT JOIN mm ON e.symbol = mm.symbol AND e.date = mm.date), "
        + "x AS ("
        + " UNION ALL ".join(f"SELECT symbol, date, open, high, low, close, volume, '{name}' AS rule, {n} AS n_rsi, {k} AS n_ema, CASE WHEN r{n} IS NULL THEN 0 WHEN r{n} > {a} AND (NOT {confirm} OR close > e{k}) THEN 1 WHEN r{n} < {f} THEN 0 END AS ev FROM j" for name, a, f, n, k, confirm in GRID)
        + f"), sg AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol, rule ORDER BY date), 0) AS signal FROM x), {_backtest_sql(part='symbol, rule')}, "
        + f"met AS ({_metrics_sql('symbol, rule, n_rsi, n_ema')}) SELECT rule, n_rsi, n_ema, round(avg(sharpe), 4) AS sharpe, count(*) AS n FROM met GROUP BY GROUPING SETS ((rule), (n_rsi), (n_ema))"
    ),
)
def _(spark, d):
    params = spark.createDataFrame(GRID, "rule string, entry double, exit_floor double, n_rsi int, n_ema int, confirm boolean")
    run = bt.backtest(signals.grid_rule(trade_bars(spark, d), params), keys=("symbol", "rule"))
    m = bt.metrics(run, keys=("symbol", "rule")).withColumn("sharpe", F.round("sharpe", 5)).join(F.broadcast(params.select("rule", "n_rsi", "n_ema")), "rule")
    m.createOrReplaceTempView("tickloom_grid")
    return spark.sql("SELECT rule, n_rsi, n_ema, round(avg(sharpe), 4) AS sharpe, count(*) AS n FROM tickloom_grid GROUP BY GROUPING SETS ((rule), (n_rsi), (n_ema))")


@query("bkt03_04_fractional", with_bars(f"""r AS (SELECT symbol, date, coalesce(close / lag(close) {_W} - 1, 0) AS r, 1.0 / count(close) OVER (PARTITION BY date) AS w FROM bars), h AS (SELECT *, coalesce(lag(w) {_W}, 0) AS h FROM r)
SELECT date, round(sum(h * r), 5) AS gross, round(sum(abs(w - h)), 5) AS turnover, round(sum(h), 5) AS exposure, round(sum(h * r) - sum(abs(w - h)) * 0.0035 / 2, 5) AS net FROM h GROUP BY date"""))
def _(spark, d):
    df = bt.portfolio_weights(trade_bars(spark, d), None)
    return rounded(bt.fractional(df, "weight"), ["date", "gross", "turnover", "exposure", "net"], 5)


@query("bkt04_inverse_vol_target_gate", with_bars(f"""r AS (SELECT symbol, date, close / lag(close) {_W} - 1 AS r FROM bars), v AS (SELECT *, {_roll('stddev_samp', 'r', 60, 30)} AS sd FROM r), w AS (SELECT symbol, date, coalesce(r, 0) AS r, coalesce(1 / nullif(sd, 0) / sum(1 / nullif(sd, 0)) OVER (PARTITION BY date), 0) AS w FROM v),
h AS (SELECT *, coalesce(lag(w) {_W}, 0) AS h FROM w), dy AS (SELECT date, sum(h * r) AS gross, sum(h) AS exposure FROM h GROUP BY date),
x AS (SELECT *, CASE WHEN count(gross) OVER f >= 20 THEN stddev_samp(gross) OVER f * sqrt(252) END AS vol, max(exposure) OVER (ORDER BY date) AS known, max(exposure) OVER () AS most FROM dy WINDOW f AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
lv AS (SELECT date, avg(close) AS level FROM bars GROUP BY date), g AS (SELECT date, level > CASE WHEN count(level) OVER f >= 200 THEN avg(level) OVER f END AS up FROM lv WINDOW f AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
SELECT x.date, round(gross, 5) AS gross, round(CASE WHEN 1 / nullif(known, 0) IS NULL THEN coalesce(0.15 / nullif(vol, 0), 1.0) ELSE least(coalesce(0.15 / nullif(vol, 0), 1.0), 1 / known) END, 5) AS scale, round(CASE WHEN 1 / nullif(most, 0) IS NULL THEN coalesce(0.15 / nullif(vol, 0), 1.0) ELSE least(coalesce(0.15 / nullif(vol, 0), 1.0), 1 / most) END, 5) AS scale_full, CAST(coalesce(up, false) AS INTEGER) AS open_gate FROM x JOIN g ON x.date = g.date"""))
def _(spark, d):
    b = trade_bars(spark, d)
    daily = bt.fractional(bt.portfolio_weights(b, None, "inverse"), "weight")
    scaled = bt.vol_target(daily).join(bt.vol_target(daily, causal=False).select("date", F.col("scale").alias("scale_full")), "date")
    gate = bt.regime_gate(b.groupBy("date").agg(F.avg("close").alias("level")))
    return rounded(scaled.join(gate, "date"), ["date", "gross", "scale", "scale_full", "open_gate"], 5)


@query("bkt05_rebalanced")
def _(spark, d):
    b = trade_bars(spark, d).withColumn("score", change(F.col("close"), 20))
    return rounded(bt.rebalanced(b, "score"), ["date", "formed", "strat", "bench", "turnover"], 5)


@query("bkt07_rank_portfolio", with_bars(f"""s AS (SELECT symbol, date, close, close / lag(close, 5) {_W} - 1 AS x FROM bars), k AS (SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(x) OVER (PARTITION BY date, x) - 1) / 2.0 END AS k FROM s),
w AS (SELECT *, coalesce(k / sum(k) OVER (PARTITION BY date), 0) AS w, coalesce(lead(close) {_W} / close - 1, 0) AS r FROM k), q AS (SELECT *, coalesce(w * (1 + r) / nullif(sum(w * (1 + r)) OVER (PARTITION BY date), 0), 0) AS dr FROM w),
t AS (SELECT *, abs(w - coalesce(lag(dr) {_W}, 0)) AS t FROM q) SELECT date, round(sum(w * r), 5) AS gross, round(sum(t), 5) AS turnover, round((1 - sum(t) * 0.001) * (1 + sum(w * r)) - 1, 5) AS net FROM t GROUP BY date"""))
def _(spark, d):
    b = trade_bars(spark, d).withColumn("x", change(F.col("close"), 5))
    return rounded(bt.rank_portfolio(b, "x", 0, 0.001), ["date", "gross", "turnover", "net"], 5)


@query("bkt06_period_backtest")
def _(spark, d):
    b = trade_bars(spark, d).withColumn("x", change(F.col("close"), 20)).withColumn("r", F.lead("close", 20).over(series()) / F.col("close") - 1)
    steps = splits.date_blocks(b).where("step % 20 = 0").select("date", (F.col("step") / 20).cast("int").alias("step"))
    return rounded(bt.period_backtest(b.join(F.broadcast(steps), "date"), "x", "r"), ["step", "segment", "strat", "bench", "traded"], 5)


@query("agg32_benchmark_bundle", with_bars(f"""sg AS (SELECT *, 1 AS signal FROM bars), {_backtest_sql()}, lv AS (SELECT date, avg(close) AS level FROM bars GROUP BY date), two AS (SELECT 'equal_weight_hold' AS name, date, avg(net) AS ret FROM eq GROUP BY date UNION ALL SELECT 'index', date, level / lag(level) OVER (ORDER BY date) - 1 FROM lv), cz AS (SELECT name, date, coalesce(ret, 0) AS ret0, ret FROM two),
q AS (SELECT *, product(1 + ret0) OVER (PARTITION BY name ORDER BY date) AS q FROM cz), dd AS (SELECT *, q / greatest(max(q) OVER (PARTITION BY name ORDER BY date), 1.0) - 1 AS dd FROM q)
SELECT name, round(stddev_samp(ret) * sqrt(252), 5) AS vol, round(avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0), 5) AS sharpe, round(min(dd), 5) AS max_dd, count(ret) AS n FROM dd GROUP BY name"""))
def _(spark, d):
    b = trade_bars(spark, d)
    return rounded(bt.benchmark_bundle(b, b.groupBy("date").agg(F.avg("close").alias("level"))), ["name", "vol", "sharpe", "max_dd", "n"], 5)


@query("bkt08_smoothed", with_bars(f"""s AS (SELECT symbol, date, close / lag(close, 5) {_W} - 1 AS x FROM bars), f AS (SELECT symbol, date, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS f FROM s), a AS (SELECT symbol, date, {_roll('avg', 'f', 10)} AS a FROM f),
c AS (SELECT *, count(a) OVER (PARTITION BY date) = count(*) OVER (PARTITION BY date) AS ok FROM a) SELECT symbol, date, round(a, 5) AS smooth FROM c WHERE ok AND a IS NOT NULL"""))
def _(spark, d):
    b = trade_bars(spark, d).withColumn("x", change(F.col("close"), 5))
    return rounded(bt.smoothed(b, "x", "smooth").where("smooth is not null"), ["symbol", "date", "smooth"], 5)


def _rank_sql(name: str, lag: int, cost: float) -> str:
    w = "coalesce(k0, 0)" if not lag else f"coalesce(lag(k0, {lag}) {_W}, 0)"
    return f"""w_{name} AS (SELECT symbol, date, r, {w} AS w FROM k1), q_{name} AS (SELECT *, coalesce(w * (1 + r) / nullif(sum(w * (1 + r)) OVER (PARTITION BY date), 0), 0) AS dr FROM w_{name}),
t_{name} AS (SELECT *, abs(w - coalesce(lag(dr) {_W}, 0)) AS t FROM q_{name}), d_{name} AS (SELECT date, (1 - sum(t) * {cost}) * (1 + sum(w * r)) - 1 AS net FROM t_{name} GROUP BY date)"""


_SETTINGS = (("free", 0, 0.0), ("cost", 0, 0.001), ("cost_lag", 1, 0.001))


@query("bkt14_three_settings", with_bars(f"""s AS (SELECT symbol, date, close, close / lag(close, 5) {_W} - 1 AS x FROM bars), k AS (SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(x) OVER (PARTITION BY date, x) - 1) / 2.0 END AS k FROM s),
k1 AS (SELECT symbol, date, k / sum(k) OVER (PARTITION BY date) AS k0, coalesce(lead(close) {_W} / close - 1, 0) AS r FROM k), {', '.join(_rank_sql(*x) for x in _SETTINGS)} """ + " UNION ALL ".join(f"SELECT '{n}' AS setting, count(*) AS n, round(avg(net), 6) AS mean FROM d_{n}" for n, *_ in _SETTINGS)))
def _(spark, d):
    """A forecast under three settings: no lag and no cost, cost, cost and a day's lag; direction accuracy without zero returns."""
    b = trade_bars(spark, d).withColumn("x", change(F.col("close"), 5))
    runs = [bt.rank_portfolio(b, "x", lag, cost).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("net"), 6).alias("mean")).select(F.lit(name).alias("setting"), "n", "mean") for name, lag, cost in _SETTINGS]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("bkt06_agg31_period_stats", with_bars(f"""f AS (SELECT symbol, date, close, lead(close, 20) {_W} / close - 1 AS r, row_number() {_W} AS i FROM bars), p AS (SELECT symbol, i, r FROM f WHERE i % 20 = 1 AND r IS NOT NULL), q AS (SELECT *, product(1 + r) OVER (PARTITION BY symbol ORDER BY i) AS q FROM p),
x AS (SELECT *, q / greatest(max(q) OVER (PARTITION BY symbol ORDER BY i), 1.0) - 1 AS dd FROM q) SELECT symbol, count(r) AS n, round(ln(arg_max(q, i)) * 12.6 / count(r), 5) AS log_cagr, round(stddev_samp(r) * sqrt(12.6), 5) AS vol, round(avg(r) / stddev_samp(r) * sqrt(12.6), 5) AS sharpe, round(min(dd), 5) AS max_dd FROM x GROUP BY symbol"""))
def _(spark, d):
    f = trade_bars(spark, d).withColumn("r", F.lead("close", 20).over(series()) / F.col("close") - 1).withColumn("i", F.row_number().over(series())).where("i % 20 = 1 and r is not null")
    m = stats.period_stats(f, "r", 12.6, ("symbol",))
    return rounded(m.withColumn("log_cagr", F.log(1 + F.col("cagr"))), ["symbol", "n", "log_cagr", "vol", "sharpe", "max_dd"], 5)


@query("agg11_joi09_alpha_beta", with_bars(f"""r AS (SELECT symbol, date, close / lag(close) {_W} - 1 AS y FROM bars), m AS (SELECT *, avg(y) OVER (PARTITION BY date) AS x FROM r), o AS (SELECT * FROM m WHERE y IS NOT NULL),
a AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a0, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, avg(x) AS mx FROM o GROUP BY symbol)
SELECT symbol, n, round(b, 5) AS beta, round(a0 * 252, 4) AS alpha, round(a0 / sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + mx * mx / sxx)), 4) AS t_alpha FROM a"""))
def _(spark, d):
    r = trade_bars(spark, d).withColumn("y", change(F.col("close"))).withColumn("x", F.avg("y").over(Window.partitionBy("date")))
    return stats.ols(r, "y", "x", ("symbol",)).select("symbol", "n", F.round("beta", 5).alias("beta"), F.round("alpha", 4).alias("alpha"), F.round("t_alpha", 4).alias("t_alpha"))


@query("agg12_correlations", with_bars("SELECT 'open' AS a, 'close' AS b, round(corr(open, close), 6) AS rho FROM bars UNION ALL SELECT 'open', 'volume', round(corr(open, volume), 6) FROM bars UNION ALL SELECT 'close', 'volume', round(corr(close, volume), 6) FROM bars"))
def _(spark, d):
    return rounded(stats.correlations(trade_bars(spark, d), ["open", "close", "volume"]), ["a", "b", "rho"])


_XS = f"""f AS (SELECT symbol, date, close / lag(close, 20) {_W} - 1 AS s, lead(close, 6) {_W} / lead(close, 1) {_W} - 1 AS r FROM bars), o AS (SELECT * FROM f WHERE s IS NOT NULL AND r IS NOT NULL)"""


@query("agg14_rank_ic", with_bars(f"""{_XS}, k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY r) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0 AS b FROM o),
c AS (SELECT date, corr(a, b) AS ic, count(*) AS n FROM k GROUP BY date HAVING count(*) >= 3 AND corr(a, b) IS NOT NULL AND NOT isnan(corr(a, b))), g AS (SELECT *, (row_number() OVER (ORDER BY date) - 1) % 4 AS o FROM c)
SELECT o AS "offset", count(*) AS n, round(avg(ic), 6) AS ic, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 4) AS t FROM g GROUP BY o"""))
def _(spark, d):
    b = trade_bars(spark, d).withColumn("s", change(F.col("close"), 20)).withColumn("r", F.lead("close", 6).over(series()) / F.lead("close", 1).over(series()) - 1)
    ic = stats.rank_ic(b, "s", "r")
    return ic.select("offset", "n", F.round("ic", 6).alias("ic"), F.round("t", 4).alias("t"))


@query("agg15_hit_rate", with_bars(f"{_XS}, m AS (SELECT *, quantile_cont(s, 0.5) OVER (PARTITION BY date) AS ms, quantile_cont(r, 0.5) OVER (PARTITION BY date) AS mr FROM o) SELECT count(*) AS n, round(avg(CAST((s > ms) = (r > mr) AS DOUBLE)), 6) AS rate FROM m"))
def _(spark, d):
    b = trade_bars(spark, d).withColumn("s", change(F.col("close"), 20)).withColumn("r", F.lead("close", 6).over(series()) / F.lead("close", 1).over(series()) - 1)
    return rounded(stats.hit_rate(b, "s", "r"), ["n", "rate"])


@query("agg16_nonoverlap_t", with_bars(f"""r AS (SELECT date, close / lag(close) {_W} - 1 AS y FROM bars), d AS (SELECT date, avg(y) AS v FROM r GROUP BY date HAVING avg(y) IS NOT NULL), g AS (SELECT v, (row_number() OVER (ORDER BY date) - 1) % 10 AS o FROM d),
x AS (SELECT o, count(*) AS n, avg(v) AS m, stddev_samp(v) AS s FROM g GROUP BY o HAVING count(*) >= 11) SELECT round(avg(m), 5) AS mean, round(avg(m / s * sqrt(n)), 4) AS t FROM x"""))
def _(spark, d):
    daily = trade_bars(spark, d).withColumn("y", change(F.col("close"))).groupBy("date").agg(F.avg("y").alias("v")).where("v is not null")
    return stats.nonoverlap_t(daily, "v", 10).select(F.round("mean", 5).alias("mean"), F.round("t", 4).alias("t"))


@query("agg18_19_bootstrap")
def _(spark, d):
    daily = bt.equal_weight(rsi_panel(spark, d))
    mean = stats.bootstrap(daily, "ret", 21, 4000).select(F.lit("mean").alias("statistic"), "*")
    return mean.unionByName(stats.bootstrap(daily, "ret", 20, 500, statistic="sharpe", circular=False).select(F.lit("sharpe").alias("statistic"), "*"))


@query("mod10_paired_difference")
def _(spark, d):
    return stats.paired_difference(bt.equal_weight(rsi_panel(spark, d)), bt.equal_weight(bt.buy_and_hold(trade_bars(spark, d))), draws=4000)


@query("agg17_lift", with_bars(f"x AS (SELECT sector, CAST(lead(close) {_W} > close AS INTEGER) AS won FROM bars), b AS (SELECT avg(won) AS base FROM x) SELECT sector, count(won) AS cases, round(avg(won), 6) AS worked, round(avg(won) - max(base), 6) AS lift, round((avg(won) - max(base)) / sqrt(max(base) * (1 - max(base)) / count(won)), 4) AS z FROM x, b GROUP BY sector"))
def _(spark, d):
    x = trade_bars(spark, d).withColumn("won", (F.lead("close").over(series()) > F.col("close")).cast("int"))
    base = x.agg(F.avg("won").alias("base"))
    v = patterns.verdicts(stats.lift(x.crossJoin(F.broadcast(base)), ["sector"], "won", F.col("base")))
    return v.select("sector", "cases", F.round("worked", 6).alias("worked"), F.round("lift", 6).alias("lift"), F.round("z", 4).alias("z"))


@query("agg20_21_scores", """WITH p AS (SELECT o_orderkey % 3 AS y, (o_orderkey * 7 + o_custkey) % 3 AS g, ((o_orderkey * 13) % 97 + 1) / 100.0 AS c FROM orders), b AS (SELECT greatest(ceil(c * 10), 1) AS b, count(*) AS n, avg(c) AS mc, avg(CAST(y = g AS DOUBLE)) AS a FROM p GROUP BY 1),
f AS (SELECT k, 2.0 * count(*) FILTER (WHERE y = k AND g = k) / (count(*) FILTER (WHERE y = k) + count(*) FILTER (WHERE g = k)) AS f1, count(*) FILTER (WHERE y = k) AS n FROM p, (VALUES (0), (1), (2)) AS v(k) GROUP BY k)
SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg(CAST(y = g AS DOUBLE)), 6) FROM p) AS accuracy, round(avg(f1), 6) AS macro_f1, round(max(n) * 1.0 / sum(n), 6) AS majority, (SELECT round(sum(abs(mc - a) * n) / sum(n), 6) FROM b) AS ece FROM f""")
def _(spark, d):
    from ..sources.bars import table

    p = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("y"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 3).alias("g"), (((F.col("o_orderkey") * 13) % 97 + 1) / 100).alias("c"))
    m = stats.confusion_metrics(p, "y", "g")
    return rounded(m.crossJoin(stats.calibration_error(p.withColumn("ok", F.col("y") == F.col("g")), "c", "ok")), ["n", "accuracy", "macro_f1", "majority", "ece"])


@query("agg22_stock_years", with_bars(f"{_RSI_SG}, {_backtest_sql()} SELECT symbol, CAST(year(date) AS INTEGER) AS year, round(product(1 + net) - 1, 5) AS strat FROM eq GROUP BY symbol, year(date)"))
def _(spark, d):
    y = stats.stock_years(rsi_panel(spark, d), bt.buy_and_hold(trade_bars(spark, d)))
    return y.select("symbol", "year", F.round("strat", 5).alias("strat"))


@query("agg23_month_ends", with_bars("SELECT symbol, last_day(date) AS date, round(arg_max(close, date), 6) AS close FROM bars GROUP BY symbol, last_day(date)"))
def _(spark, d):
    return rounded(stats.month_ends(trade_bars(spark, d), "close", ("symbol",)), ["symbol", "date", "close"])


@query("agg28_turnover", with_bars(f"""w AS (SELECT symbol, date, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM bars), t AS (SELECT date, abs(w - coalesce(lag(w) {_W}, 0)) / 2 AS t FROM w) SELECT round(sum(t), 4) AS turnover, round(sum(t) * 0.0035, 4) AS drag, round(avg(x), 6) AS per_day FROM (SELECT date, sum(t) AS t, sum(t) AS x FROM t GROUP BY date)"""))
def _(spark, d):
    daily = bt.fractional(bt.portfolio_weights(trade_bars(spark, d), None), "weight").withColumn("t", F.col("turnover") / 2)
    return daily.agg(F.round(F.sum("t"), 4).alias("turnover"), F.round(F.sum("t") * 0.0035, 4).alias("drag"), F.round(F.avg("t"), 6).alias("per_day"))


@query("agg30_survivorship", with_bars(f"""v AS (SELECT symbol, date, close, close / lag(close, 20) {_W} - 1 AS s, list(close * volume) {_frame(126)} AS l FROM bars), m AS (SELECT *, CASE WHEN len(l) >= 60 THEN list_aggregate(l, 'quantile_cont', 0.5) END AS m FROM v),
k AS (SELECT *, CASE WHEN m IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY m DESC NULLS LAST) END AS tr, CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY s NULLS LAST) + (count(s) OVER (PARTITION BY date, s) - 1) / 2.0) / count(s) OVER (PARTITION BY date) END AS sr FROM m)
SELECT symbol, round(avg(CASE WHEN sr IS NULL THEN NULL WHEN sr > 0.8 THEN 1.0 ELSE 0.0 END), 5) AS top_share, arg_min(tr, date) FILTER (WHERE tr IS NOT NULL) AS first_rank, arg_max(tr, date) FILTER (WHERE tr IS NOT NULL) AS last_rank, round(arg_max(close, date) / arg_min(close, date), 5) AS multiple FROM k GROUP BY symbol"""))
def _(spark, d):
    b = calendar.turnover_universe(trade_bars(spark, d)).withColumn("s", change(F.col("close"), 20))
    return rounded(stats.survivorship(b, "s", "turnover_rank"), ["symbol", "top_share", "first_rank", "last_rank", "multiple"], 5)


@query("agg05_06_07_summary", with_bars("""SELECT sector, round(avg(close), 5) AS mean, round(stddev_samp(close), 4) AS sd, round(min(close), 6) AS lo, round(max(close), 6) AS hi, round(quantile_cont(close, 0.5), 5) AS med, round(quantile_cont(close, 0.9), 4) AS p90, round(sum(close * volume) / sum(volume), 5) AS vwap, count(DISTINCT symbol) AS symbols, arg_max(symbol, row(close, symbol)) AS top FROM bars GROUP BY sector"""))
def _(spark, d):
    c, v = F.col("close"), F.col("volume")
    return trade_bars(spark, d).groupBy("sector").agg(
        F.round(F.avg(c), 5).alias("mean"), F.round(F.stddev_samp(c), 4).alias("sd"), F.round(F.min(c), 6).alias("lo"), F.round(F.max(c), 6).alias("hi"), F.round(F.percentile(c, F.lit(0.5)), 5).alias("med"), F.round(F.percentile(c, F.lit(0.9)), 4).alias("p90"),
        F.round(F.sum(c * v) / F.sum(v), 5).alias("vwap"), F.countDistinct("symbol").alias("symbols"), F.max_by("symbol", F.struct("close", "symbol")).alias("top"),
    )


@query("joi22_label_scores", with_bars(f"""{_LABELS}, {_RSI_SG.replace('d AS (', 'd0 AS (').replace('FROM d WHERE', 'FROM d0 WHERE')}, x AS (SELECT s.symbol, s.signal, l FROM sg s JOIN lab ON s.symbol = lab.symbol AND s.date = lab.date WHERE reason IS NULL)
SELECT symbol, count(*) AS n, round(sum(CASE WHEN signal = 1 AND l = 'Up' THEN 1 ELSE 0 END) * 1.0 / nullif(sum(signal), 0), 6) AS precision, round(avg(CASE WHEN l = 'Up' THEN 1.0 ELSE 0 END), 6) AS base FROM x GROUP BY symbol"""))
def _(spark, d):
    s = stats.label_scores(rsi_panel(spark, d).select("symbol", "date", "signal"), labels.triple_barrier(trade_bars(spark, d)))
    return rounded(s, ["symbol", "n", "precision", "base"])


@query("ind19_cross_section_features")
def _(spark, d):
    df = crosssection.ranked(crosssection.raw_features(trade_bars(spark, d)))
    return rounded(df, ["symbol", "date", *crosssection.FEATURES], 5)


@query("ind20_index_momentum", with_bars(f"""x AS (SELECT symbol, date, close / lag(close, 252) {_W} - 1 AS r12, close / lag(close, 126) {_W} - 1 AS r6, ln(close) - ln(lag(close) {_W}) AS x FROM bars), s AS (SELECT *, {_roll('stddev_samp', 'x', 252)} * sqrt(252) AS sd FROM x),
z AS (SELECT symbol, date, r12 / nullif(sd, 0) AS a, r6 / nullif(sd, 0) AS b FROM s), y AS (SELECT symbol, date, ((a - avg(a) OVER w) / nullif(stddev_samp(a) OVER w, 0) + (b - avg(b) OVER w) / nullif(stddev_samp(b) OVER w, 0)) / 2 AS m FROM z WINDOW w AS (PARTITION BY date)),
g AS (SELECT date, quantile_cont(m, 0.5) AS med FROM y GROUP BY date) SELECT symbol, y.date, round(coalesce(m, med), 5) AS idx_mom FROM y JOIN g ON y.date = g.date"""))
def _(spark, d):
    c = F.col("close")
    df = trade_bars(spark, d).withColumn("r12", change(c, 252)).withColumn("r6", change(c, 126))
    df = df.withColumn("x", F.log(c) - F.log(F.lag(c).over(series()))).withColumn("sd", rolling(F.stddev_samp, F.col("x"), 252) * 252**0.5)
    return rounded(ind.index_momentum(df, "r12", "r6", "sd"), ["symbol", "date", "idx_mom"], 5)


def _atr_panel(spark, d):
    return ind.atr_wilder(trade_bars(spark, d), 14, "atr")


_ATR = f"""t AS (SELECT *, CASE WHEN lag(close) {_W} IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) {_W}), abs(low - lag(close) {_W})) END AS tr, row_number() {_W} - 1 AS i FROM bars),
a AS (SELECT *, {sql_ewm('tr', 1 / 14)} AS atr, {_roll('avg', 'close', 20)} AS m, abs(close - open) AS body, high - low AS size, high - greatest(open, close) AS up, least(open, close) - low AS lo FROM t),
x AS (SELECT *, coalesce(close < lag(close, 5) {_W} AND close < m, false) AS dn, coalesce(close > lag(close, 5) {_W} AND close > m, false) AS rs FROM a),
l AS (SELECT *, coalesce(size > 0 AND size >= 0.5 * lag(atr) {_W}, false) AS f, lag(open) {_W} AS o1, lag(close) {_W} AS c1, lag(body) {_W} AS b1, lag(open, 2) {_W} AS o2, lag(close, 2) {_W} AS c2, lag(body, 2) {_W} AS b2, lag(atr, 3) {_W} AS a3,
  {', '.join(f'lag(dn, {k}) {_W} AS dn{k}, lag(rs, {k}) {_W} AS up{k}' for k in (1, 2, 3))} FROM x)"""
_PIN, _STAR = "f AND lo >= 2 * body AND lo >= 0.6 * size AND up <= 0.1 * size", "f AND up >= 2 * body AND up >= 0.6 * size AND lo <= 0.1 * size"
_CANDLE_SQL = {
    "Doji after uptrend": "f AND body <= 0.1 * size AND up1", "Doji after downtrend": "f AND body <= 0.1 * size AND dn1", "Hammer": f"{_PIN} AND dn1", "Hanging Man": f"{_PIN} AND up1", "Shooting Star": f"{_STAR} AND up1", "Inverted Hammer": f"{_STAR} AND dn1",
    "Bullish Engulfing": "c1 < o1 AND close > open AND open <= c1 AND close >= o1 AND body > b1 AND dn2", "Bearish Engulfing": "c1 > o1 AND close < open AND open >= c1 AND close <= o1 AND body > b1 AND up2",
    "Morning Star": "c2 < o2 AND b2 >= 0.6 * a3 AND b1 <= 0.3 * b2 AND greatest(o1, c1) < c2 AND close > open AND close > (o2 + c2) / 2 AND dn3",
    "Evening Star": "c2 > o2 AND b2 >= 0.6 * a3 AND b1 <= 0.3 * b2 AND least(o1, c1) > c2 AND close < open AND close < (o2 + c2) / 2 AND up3",
}


_EVENTS = f"{_ATR}, ev AS (" + " UNION ALL ".join(f"SELECT symbol, date, '{k}' AS pattern, {patterns.CANDLES[k]} AS dir FROM l WHERE {v}" for k, v in _CANDLE_SQL.items()) + ")"
_DAYS = (1, 2, 5, 10, 20, 40, 60)
_SCORES = f"""{_EVENTS}, hz AS (SELECT symbol, date, {', '.join(f'lead(close, {k}) {_W} / lead(open) {_W} - 1 AS h{k}' for k in _DAYS)} FROM bars),
lg AS ({' UNION ALL '.join(f'SELECT symbol, date, {k} AS horizon, h{k} AS ret FROM hz WHERE h{k} IS NOT NULL' for k in _DAYS)}), bs AS (SELECT horizon, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS up, avg(ret) AS mean FROM lg GROUP BY horizon),
mid AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.5) AS mid FROM bars), jn AS (SELECT e.pattern, e.dir, e.date, g.horizon, g.ret, b.up, b.mean, CASE WHEN g.ret * e.dir > 0 THEN 1.0 ELSE 0.0 END AS won FROM ev e JOIN lg g ON e.symbol = g.symbol AND e.date = g.date JOIN bs b ON g.horizon = b.horizon),
sc AS (SELECT pattern, horizon, count(*) AS cases, avg(won) AS hit, avg(CASE WHEN dir > 0 THEN up ELSE 1 - up END) AS base, avg((ret - mean) * dir) AS excess, avg(CASE WHEN date_diff('day', DATE '1970-01-01', date) <= mid THEN won END) AS first_half, avg(CASE WHEN date_diff('day', DATE '1970-01-01', date) > mid THEN won END) AS second_half
  FROM jn, mid GROUP BY pattern, horizon)"""


def _outcome_sql(name: str, d: int, k: float = 1.0, horizon: int = 20) -> str:
    """Table ``name``: each bar's first touch of a target and a stop, k ATR from the next open, after table a (bars with atr and i)."""
    good, bad = ("high", "low") if d > 0 else ("low", "high")
    ge, le, worse = (">=", "<=", "least") if d > 0 else ("<=", ">=", "greatest")
    return f"""e_{name} AS (SELECT symbol, i, date, lead(open) {_W} AS e, lead(open) {_W} + {d * k} * atr AS g, lead(open) {_W} - {d * k} * atr AS s, least((SELECT max(i) FROM a z WHERE z.symbol = a.symbol) - i, {horizon}) AS ahead, atr FROM a),
h_{name} AS (SELECT x.symbol, x.date, b.i - x.i AS day, CASE WHEN b.i > x.i + 1 AND b.open {ge} x.g THEN 1 WHEN b.{bad} {le} x.s THEN 0 ELSE 1 END AS win, CASE WHEN b.i > x.i + 1 AND b.open {ge} x.g THEN b.open WHEN b.{bad} {le} x.s THEN CASE WHEN b.i > x.i + 1 THEN {worse}(b.open, x.s) ELSE x.s END ELSE x.g END AS p
  FROM e_{name} x JOIN a b ON x.symbol = b.symbol AND b.i BETWEEN x.i + 1 AND x.i + {horizon} WHERE x.e IS NOT NULL AND ((b.i > x.i + 1 AND b.open {ge} x.g) OR b.{bad} {le} x.s OR b.{good} {ge} x.g)),
f_{name} AS (SELECT symbol, date, min(day) AS day, arg_min(win, day) AS win, arg_min(p, day) AS p FROM h_{name} GROUP BY symbol, date),
{name} AS (SELECT x.symbol, x.date, f.win AS out_win, f.day AS out_day, CASE WHEN f.win IS NOT NULL THEN {d} * (f.p / x.e - 1) WHEN x.ahead = {horizon} THEN {d} * (c.close / x.e - 1) END AS out_ret FROM e_{name} x LEFT JOIN f_{name} f ON x.symbol = f.symbol AND x.date = f.date LEFT JOIN a c ON c.symbol = x.symbol AND c.i = x.i + {horizon})"""


_TRUE_ATR = _ATR.split(",\nx AS")[0]
ORACLE_SQL["lab04_outcomes"] = with_bars(f"{_TRUE_ATR}, {_outcome_sql('ou', 1)} SELECT symbol, date, out_win, out_day, round(out_ret, 6) AS out_ret FROM ou")


@query("pat06_candles", with_bars(f"{_ATR} " + " UNION ALL ".join(f"SELECT symbol, date, '{k}' AS pattern, {patterns.CANDLES[k]} AS dir FROM l WHERE {v}" for k, v in _CANDLE_SQL.items())))
def _(spark, d):
    return patterns.candle_events(patterns.candle_signals(_atr_panel(spark, d)))


@query("pat01_04_chart_events")
def _(spark, d):
    return rounded(patterns.chart_events(_atr_panel(spark, d)), ["symbol", "pattern", "date", "dir", "trigger", "stop", "target", "height", "start"])


@query("pat05_flags")
def _(spark, d):
    return rounded(patterns.flag_events(_atr_panel(spark, d)), ["symbol", "pattern", "date", "dir", "trigger", "stop", "target", "length"], 5)


@query("lab05_pat07_agg25_measured_moves")
def _(spark, d):
    b = _atr_panel(spark, d)
    ev = patterns.chart_events(b).select("symbol", "pattern", "date", "dir", "stop", "target")
    fake = labels.measured_moves(patterns.placebo(ev, b), b)
    return rounded(patterns.measured_summary(labels.measured_moves(ev, b), fake), ["pattern", "trades", "target_first", "stop_first", "mean_ret", "break_even", "placebo_target_first", "edge"], 5)


@query("agg24_pat08_09_scores", with_bars(f"{_SCORES} SELECT pattern, horizon, cases, round(hit, 5) AS hit, round(base, 5) AS base, round(excess, 5) AS excess, round(first_half, 5) AS first_half, round(second_half, 5) AS second_half FROM sc"))
def _(spark, d):
    b = _atr_panel(spark, d)
    ev = patterns.candle_events(patterns.candle_signals(b))
    return rounded(patterns.scored(ev, b, (1, 2, 5, 10, 20, 40, 60)), ["pattern", "horizon", "cases", "hit", "base", "excess", "first_half", "second_half"], 5)


@query("pat08_filters", with_bars(f"""{_EVENTS}, f AS (SELECT symbol, date, lead(close, 10) {_W} / lead(open) {_W} - 1 AS ret, lead(close, 11) {_W} / lead(open, 2) {_W} - 1 AS late, sign(close - {_roll('avg', 'close', 50)}) AS trend, high - low > {_roll('avg', 'size', 20)} AS wide, volume > {_roll('avg', 'volume', 20)} AS busy, sign(lead(close) {_W} - close) AS nxt FROM (SELECT *, high - low AS size FROM bars)),
j AS (SELECT e.pattern, e.dir, f.* FROM ev e JOIN f ON e.symbol = f.symbol AND e.date = f.date), o AS (SELECT pattern, dir, 'all' AS filter, ret AS r FROM j UNION ALL SELECT pattern, dir, 'trend', ret FROM j WHERE trend = dir UNION ALL SELECT pattern, dir, 'wide', ret FROM j WHERE wide UNION ALL SELECT pattern, dir, 'busy', ret FROM j WHERE busy
UNION ALL SELECT pattern, dir, 'confirmed', late FROM j WHERE nxt = dir UNION ALL SELECT pattern, dir, 'late', late FROM j) SELECT pattern, filter, count(*) AS cases, round(avg(CASE WHEN r * dir > 0 THEN 1.0 ELSE 0.0 END), 5) AS hit FROM o WHERE r IS NOT NULL GROUP BY pattern, filter"""))
def _(spark, d):
    b = _atr_panel(spark, d)
    return rounded(patterns.filtered_accuracy(patterns.candle_events(patterns.candle_signals(b)), b), ["pattern", "filter", "cases", "hit"], 5)


@query("pat09_best_horizon", with_bars(f"""{_SCORES}, ea AS (SELECT pattern, arg_max(horizon, row(excess, -horizon)) AS best_day, max(excess) AS early_excess FROM sc WHERE horizon BETWEEN 1 AND 10 GROUP BY pattern), la AS (SELECT pattern, avg(excess) AS late_excess FROM sc WHERE horizon BETWEEN 20 AND 60 GROUP BY pattern)
SELECT ea.pattern, best_day, round(early_excess, 5) AS early_excess, round(late_excess, 5) AS late_excess FROM ea LEFT JOIN la ON ea.pattern = la.pattern"""))
def _(spark, d):
    b = _atr_panel(spark, d)
    s = patterns.scored(patterns.candle_events(patterns.candle_signals(b)), b, (1, 2, 5, 10, 20, 40, 60))
    return rounded(patterns.best_horizon(s, (1, 10), (20, 60)), ["pattern", "best_day", "early_excess", "late_excess"], 5)


@query("pat10_joi06_verdicts", with_bars(f"""{_EVENTS}, {_outcome_sql('ou', 1)}, {_outcome_sql('od', -1)}, sd AS (SELECT symbol, date, 1 AS dir, out_win FROM ou UNION ALL SELECT symbol, date, -1, out_win FROM od), bb AS (SELECT dir, avg(out_win) AS base FROM sd GROUP BY dir),
g AS (SELECT pattern, count(out_win) AS cases, avg(out_win) AS worked, max(base) AS base FROM ev JOIN sd ON ev.symbol = sd.symbol AND ev.date = sd.date AND ev.dir = sd.dir JOIN bb ON ev.dir = bb.dir GROUP BY pattern), z AS (SELECT *, worked - base AS lift, (worked - base) / nullif(sqrt(base * (1 - base) / nullif(cases, 0)), 0) AS z FROM g)
SELECT pattern, cases, round(worked, 5) AS worked, round(base, 5) AS base, round(lift, 5) AS lift, round(z, 5) AS z, CASE WHEN cases < 30 THEN 'no data' WHEN lift >= 0.02 AND z >= 1.5 THEN 'works (better than a random day)' WHEN lift >= 0.01 THEN 'slightly better than random, not reliable' WHEN lift <= -0.02 AND z <= -2 THEN 'worse than a random day' ELSE 'no better than a random day' END AS verdict FROM z"""))
def _(spark, d):
    b = _atr_panel(spark, d)
    ev = patterns.candle_events(patterns.candle_signals(b))
    sides = labels.outcomes(b, 1).select("symbol", "date", F.lit(1).alias("dir"), "out_win").unionByName(labels.outcomes(b, -1).select("symbol", "date", F.lit(-1).alias("dir"), "out_win"))
    base = sides.groupBy("dir").agg(F.avg("out_win").alias("base"))
    rows = ev.join(sides, ["symbol", "date", "dir"]).join(F.broadcast(base), "dir")  # two rows
    return rounded(patterns.verdicts(stats.lift(rows, ["pattern"], "out_win", F.col("base"))), ["pattern", "cases", "worked", "base", "lift", "z", "verdict"], 5)


@query("pat11_scan", with_bars(f"""{_EVENTS}, {_outcome_sql('ou', 1)}, {_outcome_sql('od', -1)}, sd AS (SELECT *, 1 AS dir FROM ou UNION ALL SELECT *, -1 FROM od), rk AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS n FROM bars WHERE symbol = 'NATION_1')
SELECT ev.date, ev.pattern, ev.dir, CASE WHEN out_win = 1 THEN 'won' WHEN out_win = 0 THEN 'lost' WHEN out_ret IS NULL THEN 'open' ELSE 'timeout' END AS status, round(out_ret, 6) AS ret FROM ev JOIN sd ON ev.symbol = sd.symbol AND ev.date = sd.date AND ev.dir = sd.dir JOIN rk ON ev.date = rk.date WHERE ev.symbol = 'NATION_1' AND rk.n <= 200"""))
def _(spark, d):
    return rounded(patterns.scan(trade_bars(spark, d), "NATION_1", 200), ["date", "pattern", "dir", "status", "ret"])


def _model_data(spark, d):
    b = kept(trade_bars(spark, d))
    lab = labels.triple_barrier(b).where("dropped_reason is null")
    cal = calendar.trading_calendar(b)
    ends = kept(splits.with_window_end(lab, cal))
    feats = b.withColumn("f1", change(F.col("close"), 5)).withColumn("f2", (F.col("high") - F.col("low")) / F.col("close")).withColumn("f3", F.log1p("volume"))
    # all rows have all columns, those of the expanded set too, so that sets of features are compared on the same rows
    feats = feats.withColumn("f4", change(F.col("close"), 20)).withColumn("f5", rolling(F.avg, F.col("f2"), 20)).select("symbol", "date", "f1", "f2", "f3", "f4", "f5").na.drop()
    data = kept(models.indexed(ends.select("symbol", "date", "label")).join(feats, ["symbol", "date"]))
    return data, ends, cal


@query("mod01_11_prj04_predictions")
def _(spark, d):
    """Every fold's test rows with raw and calibrated probabilities and the decision."""
    data, ends, cal = _model_data(spark, d)
    said = models.decide(models.calibrated_folds(data, splits.folds(ends, fold_ranges(spark), cal), ends, ["f1", "f2", "f3"]))
    return rounded(said, ["fold", "symbol", "date", "y", "guess", "p_down", "p_flat", "p_up", "p_down_cal", "p_flat_cal", "p_up_cal", "decision"], 4)


#: Families of features: momentum, volatility, volume.
FAMILIES = {"momentum": ["f1"], "volatility": ["f2"], "volume": ["f3"]}


@query("mod02_07_boosted_specialist")
def _(spark, d):
    """Boosted trees of all features, rows weighted by inverse class frequency in each fold's training rows."""
    data, ends, cal = _model_data(spark, d)
    said = models.fold_predictions(data, splits.folds(ends, fold_ranges(spark), cal), ["f1", "f2", "f3"], "boosted", weighted=True, trees=3, depth=3)
    return rounded(stats.confusion_metrics(said, "y", "guess", ("fold",)), ["fold", "n", "accuracy", "macro_f1", "majority"], 5)


#: The family of each column of the feature table, in the table's order.
_FAMILY_OF = dict(zip(ind.CONTINUOUS, ["momentum"] * 5 + ["trend"] * 5 + ["volatility"] * 8 + ["volume"] * 4)) | dict(zip([f"vote_{v}" for v in ind.VOTES], ["momentum"] * 4 + ["trend"] * 3 + ["volatility"] * 3 + ["volume"] * 3))


def _feature_data(spark, d):
    """symbol, date, y and the 35 columns of the feature table; folds of the labels."""
    # windows by symbol cost more here than the panel's few MB let Spark guess, so their number of tasks is set
    b = kept(trade_bars(spark, d)).repartition(spark.sparkContext.defaultParallelism, "symbol")
    lab = kept(splits.with_window_end(labels.triple_barrier(b).where("dropped_reason is null"), calendar.trading_calendar(b)))
    data = models.indexed(lab.select("symbol", "date", "label")).join(ind.feature_table(b), ["symbol", "date"])
    return data, splits.folds(lab, fold_ranges(spark), calendar.trading_calendar(b))


@query("mod02_softmax_boosting")
def _(spark, d):
    """Softmax boosting on the feature table: every test row's three probabilities, all folds grown together."""
    data, assigned = _feature_data(spark, d)
    said = boosting.boosted_predictions(data, assigned, list(_FAMILY_OF), rounds=6, depth=3)
    return rounded(said, ["fold", "symbol", "date", "y", "guess", "p_down", "p_flat", "p_up"], 4)


@query("mod07_family_importance")
def _(spark, d):
    """Which family of columns the boosted trees gain by, and each column's share, fold by fold."""
    data, assigned = _feature_data(spark, d)
    _, nodes = boosting.boosted_rows(data, assigned, list(_FAMILY_OF), rounds=3, depth=3)
    whole = boosting.gain_shares(nodes, _FAMILY_OF).withColumnRenamed("feature", "family").withColumnRenamed("importance", "family_share")
    each = boosting.gain_shares(nodes)
    family = F.create_map(*[F.lit(x) for pair in _FAMILY_OF.items() for x in pair])
    return rounded(each.withColumn("family", F.element_at(family, F.col("feature"))).join(whole, ["fold", "family"]), ["fold", "family", "feature", "importance", "family_share"], 4)


@query("mod07_importance")
def _(spark, d):
    data, ends, cal = _model_data(spark, d)
    return rounded(models.fold_importance(data, splits.folds(ends, fold_ranges(spark), cal), ["f1", "f2", "f3"], "forest", trees=10, depth=4), ["fold", "feature", "importance"], 5)


@query("mod03_calibrated")
def _(spark, d):
    """What calibration on the held-out slice does to each fold: log loss of raw and of calibrated probabilities."""
    data, ends, cal = _model_data(spark, d)
    said = models.calibrated_folds(data, splits.folds(ends, fold_ranges(spark), cal), ends, ["f1", "f2", "f3"])
    loss = lambda end: F.round(stats.log_loss_of("y", {0.0: f"p_down{end}", 1.0: f"p_flat{end}", 2.0: f"p_up{end}"}), 4)
    return said.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), loss("").alias("log_loss"), loss("_cal").alias("log_loss_cal"))


@query("mod07_08_12_ablation")
def _(spark, d):
    """One family alone, all of them, and all with two more columns, under both fold rules."""
    data, ends, cal = _model_data(spark, d)
    schemes = {rule: splits.folds(ends, fold_ranges(spark), cal, rule=rule) for rule in ("embargo_shadow", "drop_all_after_prior_test")}
    return rounded(models.ablation(data, schemes, {"momentum": FAMILIES["momentum"], "all": ["f1", "f2", "f3"], "expanded": ["f1", "f2", "f3", "f4", "f5"]}, max_iter=10), ["features", "scheme", "model", "n", "accuracy", "macro_f1"], 5)


@query("mod04_shuffled_labels", with_bars(f"{_LABELS} SELECT symbol, l AS label, count(*) AS n, true AS moved FROM lab WHERE reason IS NULL GROUP BY symbol, l"))
def _(spark, d):
    lab = labels.triple_barrier(trade_bars(spark, d)).where("dropped_reason is null").select("symbol", "date", "label")
    # labels keep their numbers, and as many rows take another label as a permutation lets one expect
    mixed = models.shuffled(lab, "label", ["symbol"]).join(lab.withColumnRenamed("label", "was"), ["symbol", "date"])
    return models.label_moves(mixed, "label", "was", ["symbol"]).groupBy("symbol", "label", "moved").agg(F.count(F.lit(1)).alias("n"))


@query("mod05_ridge", with_bars(f"""f AS (SELECT close / lag(close, 5) {_W} - 1 AS x, lead(close) {_W} / close - 1 AS y FROM bars), o AS (SELECT * FROM f WHERE x IS NOT NULL AND y IS NOT NULL) SELECT 'x' AS name, round(regr_sxy(y, x) / (regr_sxx(y, x) + 100), 6) AS coefficient FROM o"""))
def _(spark, d):
    df = trade_bars(spark, d).withColumn("x", change(F.col("close"), 5)).withColumn("y", F.lead("close").over(series()) / F.col("close") - 1)
    _, beta = models.ridge_normal(df, ["x"], "y")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in beta.items()], "name string, coefficient double")


_SYMBOLS = [f"NATION_{i}" for i in range(25)]
#: Every two of ten blocks, four sets of held-out symbols each: 180 paths.
_PATHS = splits.combinatorial_choices(_SYMBOLS, 10, 2, 4, 0.3, 5)
_PATH_VALUES = ", ".join(f"({p}, {t[0]}, {t[1]}, {[int(s.removeprefix('NATION_')) for s in h]})" for p, (t, h) in enumerate(_PATHS))


@query("mod05_path_ridge", with_bars(f"""pl(path, t0, t1, held) AS (VALUES {_PATH_VALUES}), f AS (SELECT symbol, date, close / lag(close, 5) {_W} - 1 AS x, close / lag(close, 20) {_W} - 1 AS z, lead(close, 5) {_W} / close - 1 AS y FROM bars),
g AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS step, ntile(10) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM bars)),
o AS MATERIALIZED (SELECT CAST(substr(symbol, 8) AS INTEGER) AS k, step, x, z, y FROM f JOIN g ON f.date = g.date WHERE x IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL), e AS (SELECT block, min(step) AS lo, max(step) AS hi FROM g GROUP BY block),
b AS (SELECT path, held, a.lo - 6 AS lo0, a.hi + 6 AS hi0, c.lo - 6 AS lo1, c.hi + 6 AS hi1 FROM pl JOIN e a ON a.block = t0 JOIN e c ON c.block = t1),
m AS (SELECT path, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * count(*) + 100 AS xx, var_pop(z) * count(*) + 100 AS zz, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy
  FROM b JOIN o ON NOT (step BETWEEN lo0 AND hi0) AND NOT (step BETWEEN lo1 AND hi1) AND NOT list_contains(held, k) GROUP BY path),
c AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM m)
SELECT path, n, round(my - mx * bx - mz * bz, 6) AS intercept, round(bx, 6) AS beta_x, round(bz, 6) AS beta_z FROM c"""))
def _(spark, d):
    """Ridge of two returns on 180 paths, from one pass over the panel."""
    b = kept(trade_bars(spark, d).select("symbol", "date", "close"))
    c = F.col("close")
    df = b.withColumns({"x": change(c, 5), "z": change(c, 20), "y": F.lead("close", 5).over(series()) / c - 1})
    fitted = paths.path_ridge(paths.path_sums(paths.cells(df, splits.date_blocks(b), ["x", "z", "y"]), _PATHS), 2)
    return rounded(fitted.select("path", "n", "intercept", F.get("beta", F.lit(0)).alias("beta_x"), F.get("beta", F.lit(1)).alias("beta_z")), ["path", "n", "intercept", "beta_x", "beta_z"])


@query("mod05_path_scores")
def _(spark, d):
    """24 ranked features, weekly: what ridge and plain momentum are worth on the held-out symbols of each of 180 paths."""
    b, features = kept(trade_bars(spark, d)), list(crosssection.FEATURES)
    weekly = splits.date_blocks(b).where("step % 5 = 0").select("date")  # a row a date
    raw = kept(crosssection.raw_features(b).select("symbol", "date", *features).join(F.broadcast(weekly), "date"))
    panel = kept(crosssection.ranked(raw).join(labels.forward_return(b).select("symbol", "date", "fwd_ret", "y_rank"), ["symbol", "date"]))
    dates = kept(splits.date_blocks(panel))
    fitted = paths.path_ridge(paths.path_sums(paths.cells(panel, dates, [*features, "y_rank"]), _PATHS), len(features))
    scored = paths.ridge_scores(paths.path_tests(panel, dates, _PATHS), fitted, features)
    return rounded(paths.path_quality(scored, {"ridge": "score", "momentum": "mom_12_1"}), ["path", "model", "n", "accuracy", "rank_ic"], 5)


@query("mod06_regressors")
def _(spark, d):
    # kept, since each fit goes over its rows many times, and from bars that is the line items each time
    df = trade_bars(spark, d).withColumn("x", change(F.col("close"), 5)).withColumn("z", change(F.col("close"))).withColumn("y", F.lead("close").over(series()) / F.col("close") - 1).na.drop()
    df, rows, cut = kept(df.select("symbol", "date", "x", "z", "y")), [], "1999-01-01"
    train, test = df.where(F.col("date") < cut), df.where(F.col("date") >= cut)
    for kind in ("ridge", "lasso", "forest", "boosted"):
        fit = models.regressor(kind, ["x", "z"], "y", trees=20, depth=5).fit(train)
        rows.append((kind, float(fit.transform(test).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2)))).first()[0])))
    return spark.createDataFrame(rows, "model string, mse double")


@query("mod09_claims", with_bars(f"""f AS (SELECT symbol, date, close / lag(close, 20) {_W} - 1 AS s, {', '.join(f'lead(close, {h + 1}) {_W} / lead(close, 1) {_W} - 1 AS r{h}' for h in (5, 21, 63))} FROM bars),
o AS ({' UNION ALL '.join(f'SELECT symbol, date, {h} AS horizon, s, r{h} AS r FROM f WHERE s IS NOT NULL AND r{h} IS NOT NULL' for h in (5, 21, 63))}),
k AS (SELECT horizon, date, rank() OVER (PARTITION BY horizon, date ORDER BY s) + (count(*) OVER (PARTITION BY horizon, date, s) - 1) / 2.0 AS ks, rank() OVER (PARTITION BY horizon, date ORDER BY r) + (count(*) OVER (PARTITION BY horizon, date, r) - 1) / 2.0 AS kr,
  CASE WHEN (s > quantile_cont(s, 0.5) OVER (PARTITION BY horizon, date)) = (r > quantile_cont(r, 0.5) OVER (PARTITION BY horizon, date)) THEN 1.0 ELSE 0.0 END AS ok FROM o),
dy AS (SELECT horizon, date, count(*) AS k, sum(ok) AS ok, CASE WHEN count(*) >= 3 AND NOT isnan(corr(ks, kr)) THEN corr(ks, kr) END AS ic FROM k GROUP BY horizon, date), bl AS (SELECT date, ntile(10) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM bars)),
j AS (SELECT dy.*, block FROM dy JOIN bl ON dy.date = bl.date), p AS (SELECT *, 'all' AS part FROM j UNION ALL SELECT *, CASE WHEN block % 2 = 0 THEN 'design' ELSE 'confirm' END FROM j)
SELECT horizon, part, CAST(sum(k) AS BIGINT) AS n, round(sum(ok) / sum(k), 5) AS rate, round(avg(ic), 5) AS ic FROM p GROUP BY horizon, part"""))
def _(spark, d):
    """A score's rank IC and hit rate at horizons 5, 21, 63, on design blocks, on the others and on all."""
    b = trade_bars(spark, d).withColumn("s", change(F.col("close"), 20))
    lead = lambda n: F.lead("close", n).over(series())
    b = b.withColumns({f"r{h}": lead(h + 1) / lead(1) - 1 for h in (5, 21, 63)})
    x = b.select("symbol", "date", "s", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"r{h}").alias("r")) for h in (5, 21, 63)])).alias("h")).select("symbol", "date", "s", "h.*").where("s is not null and r is not null")
    day = Window.partitionBy("horizon", "date")
    rank = lambda c: F.rank().over(day.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("horizon", "date", c)) - 1) / 2
    med = lambda c: F.percentile(c, F.lit(0.5)).over(day)
    x = x.withColumns({"ks": rank("s"), "kr": rank("r"), "ok": ((F.col("s") > med("s")) == (F.col("r") > med("r"))).cast("double")})
    daily = x.groupBy("horizon", "date").agg(F.count(F.lit(1)).alias("k"), F.sum("ok").alias("ok"), stats.pearson("ks", "kr").alias("ic"))
    daily = daily.withColumn("ic", F.when((F.col("k") >= 3) & ~F.isnan("ic"), F.col("ic"))).join(splits.date_blocks(b).select("date", "block"), "date")
    part = F.explode(F.array(F.lit("all"), F.when(F.col("block") % 2 == 0, "design").otherwise("confirm")))
    g = daily.withColumn("part", part).groupBy("horizon", "part").agg(F.sum("k").alias("n"), (F.sum("ok") / F.sum("k")).alias("rate"), F.avg("ic").alias("ic"))
    return rounded(g, ["horizon", "part", "n", "rate", "ic"], 5)
