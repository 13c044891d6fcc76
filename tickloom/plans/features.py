"""The feature table of 22 columns and 13 votes, and what is asked of it, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..functions.rolling import so_far
from ..operators import backtest as bt
from ..operators import indicators as ind
from ..operators import signals, stats
from ..sources.bars import trade_bars
from .base import query, recursive, rounded, sql_ewm, sql_ewm_seeded, sql_rounded, with_bars
from .indicators import _K, _TR, _W, _frame, _roll, _rsi_sql
from .strategy import _backtest_sql, _state

_VOTE_NAMES = [f"vote_{v}" for v in ind.VOTES]
_MOVES = ("u", "n", "p", "q", "tr")


def _vote(name: str, up: str, down: str | None = None) -> str:
    return f"CASE WHEN {up} THEN 1 {f'WHEN {down} THEN -1 ' if down else ''}ELSE 0 END AS vote_{name}"


#: Table ``ft``: bars with the feature table's columns. Means that start late run over tables of their own: moves (mv), directions (dx), MACD lines (ml).
FEATURES = f"""f1 AS (SELECT *, row_number() {_W} - 1 AS i, (high + low + close) / 3 AS t, {_K} AS k, {_roll('max', 'high', 14)} AS hh, {_roll('min', 'low', 14)} AS ll,
  close - lag(close) {_W} AS d, high - lag(high) {_W} AS up, lag(low) {_W} - low AS dn, {_TR} AS tr, CASE WHEN lag(close) {_W} IS NULL THEN volume ELSE sign(close - lag(close) {_W}) * volume END AS step,
  CASE WHEN high > low THEN (2 * close - low - high) / (high - low) ELSE 0 END * volume AS mf, (close / lag(close) {_W} - 1) * volume AS rv FROM bars),
f2 AS (SELECT *, {_roll('avg', 'k', 3)} AS stoch_k, {_roll('avg', 't', 20)} AS tm, list(t) {_frame(20)} AS ts, {sql_ewm_seeded('close', 2 / 21, 20)} AS ema20, {sql_ewm_seeded('close', 2 / 51, 50)} AS ema50,
  CASE WHEN i >= 25 THEN {sql_ewm('close', 2 / 13)} - {sql_ewm('close', 2 / 27)} END AS macd_line, {_roll('avg', 'close', 20)} AS bb_mid, {_roll('stddev_pop', 'close', 20)} AS sd,
  sum(step) {_W} AS obv, sum(mf) {_W} AS ad, {_roll('sum', 'rv', 20)} / nullif({_roll('sum', 'volume', 20)}, 0) AS vwpm20 FROM f1),
f3 AS (SELECT *, {_roll('avg', 'stoch_k', 3)} AS stoch_d, list_sum(list_transform(ts, lambda x: abs(x - tm))) / 20 AS dev, CASE WHEN hh > ll THEN -100 * (hh - close) / (hh - ll) END AS willr, CASE WHEN i >= 19 THEN {sql_ewm('obv', 2 / 21)} END AS obv_ema FROM f2),
mv AS (SELECT symbol, date, i - 1 AS i, greatest(d, 0) AS u, greatest(-d, 0) AS n, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS q, tr FROM f1 WHERE i >= 1),
ms AS (SELECT symbol, date, {', '.join(f'{sql_ewm_seeded(x, 1 / 14, 14)} AS {x}' for x in _MOVES)} FROM mv),
dr AS (SELECT symbol, date, 100 * p / nullif(tr, 0) AS pdi, 100 * q / nullif(tr, 0) AS mdi FROM ms),
dx AS (SELECT symbol, date, row_number() {_W} - 1 AS i, 100 * abs(pdi - mdi) / (pdi + mdi) AS dx FROM dr WHERE pdi + mdi <> 0),
ax AS (SELECT symbol, date, {sql_ewm_seeded('dx', 1 / 14, 14)} AS adx FROM dx),
ml AS (SELECT symbol, date, i - 25 AS i, macd_line FROM f3 WHERE i >= 25), mg AS (SELECT symbol, date, CASE WHEN i >= 8 THEN {sql_ewm('macd_line', 0.2)} END AS macd_signal FROM ml),
f4 AS (SELECT f3.* EXCLUDE (tr), {_rsi_sql('ms.u', 'ms.n')} AS rsi14, CASE WHEN dev > 0 THEN (t - tm) / (0.015 * dev) END AS cci, adx, macd_signal, ms.tr AS atr14, ms.tr / nullif(close, 0) AS atr_pct, bb_mid + 2 * sd AS bb_up, bb_mid - 2 * sd AS bb_low,
  ema20 + 2 * ms.tr AS kc_up, ema20 AS kc_mid, ema20 - 2 * ms.tr AS kc_low
  FROM f3 LEFT JOIN ms ON f3.symbol = ms.symbol AND f3.date = ms.date LEFT JOIN ax ON f3.symbol = ax.symbol AND f3.date = ax.date LEFT JOIN mg ON f3.symbol = mg.symbol AND f3.date = mg.date),
f5 AS (SELECT *, list(atr_pct) FILTER (WHERE atr_pct IS NOT NULL) {_frame(252)} AS ranges, lag(ad, 20) {_W} AS ad20 FROM f4),
ft AS (SELECT *, {_vote('rsi', 'rsi14 < 30', 'rsi14 > 70')}, {_vote('stoch', 'stoch_k < 20', 'stoch_k > 80')}, {_vote('cci', 'cci < -100', 'cci > 100')}, {_vote('willr', 'willr < -80', 'willr > -20')},
  {_vote('ema', 'ema20 > ema50', 'ema20 < ema50')}, {_vote('adx', 'adx > 25')}, {_vote('macd', 'macd_line > macd_signal', 'macd_line < macd_signal')}, {_vote('bb', 'close < bb_low', 'close > bb_up')}, {_vote('kc', 'close > kc_up', 'close < kc_low')},
  {_vote('vol', 'atr_pct IS NOT NULL AND len(ranges) >= 60 AND (len(list_filter(ranges, lambda v: v < atr_pct)) + (len(list_filter(ranges, lambda v: v = atr_pct)) + 1) / 2.0) / len(ranges) > 0.75')},
  {_vote('obv', 'obv > obv_ema', 'obv < obv_ema')}, {_vote('ad', 'round(ad, 6) > round(ad20, 6)', 'round(ad, 6) < round(ad20, 6)')}, {_vote('vwpm', 'vwpm20 > 0', 'vwpm20 < 0')} FROM f5)"""


@query("ind25_26_votes_and_features", with_bars(f"{FEATURES} SELECT symbol, date, {sql_rounded(ind.CONTINUOUS, 5)}, {', '.join(_VOTE_NAMES)} FROM ft"))
def _(spark, d):
    return rounded(ind.feature_table(trade_bars(spark, d)), ["symbol", "date", *ind.CONTINUOUS, *_VOTE_NAMES], 5)


#: Votes that tell a regime and open no position.
_REGIMES = ("vote_adx", "vote_vol")
_RULES = [v for v in _VOTE_NAMES if v not in _REGIMES]



@query(
    "agg12_13_vote_clusters",
    recursive(with_bars(f"""{FEATURES}, vt AS MATERIALIZED (SELECT symbol, date, open, high, low, close, volume, {', '.join(_VOTE_NAMES)} FROM ft),
co AS MATERIALIZED (SELECT {', '.join(f'corr({a}, {b}) AS {a}__{b}' for i, a in enumerate(_VOTE_NAMES) for b in _VOTE_NAMES[i + 1:])} FROM vt),
pr AS MATERIALIZED (SELECT split_part(pair, '__', 1) AS a, split_part(pair, '__', 2) AS b, rho FROM (UNPIVOT co ON COLUMNS(*) INTO NAME pair VALUE rho)),
nm AS (SELECT unnest({_VOTE_NAMES!r}) AS name, unnest(range({len(_VOTE_NAMES)})) AS place), li AS (SELECT a, b FROM pr WHERE abs(rho) > 0.6 UNION ALL SELECT b, a FROM pr WHERE abs(rho) > 0.6),
rc(name, other) AS (SELECT name, name FROM nm UNION SELECT rc.name, li.b FROM rc JOIN li ON rc.other = li.a), cl AS (SELECT rc.name, CAST(min(place) AS INTEGER) AS cluster FROM rc JOIN nm ON rc.other = nm.name GROUP BY rc.name),
sv AS (UNPIVOT vt ON {', '.join(_RULES)} INTO NAME name VALUE vote), sg AS (SELECT * REPLACE (name || ':' || symbol AS symbol) FROM sv), sh AS (SELECT *, {_state('vote = 1', 'vote = -1', 'true')} AS signal FROM sg),
{_backtest_sql(source='sh')}, pf AS (SELECT name, date, avg(net) AS ret FROM eq GROUP BY name, date), sc AS (SELECT name, avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0) AS score FROM pf GROUP BY name),
ea AS (SELECT cl.*, score, coalesce(score, '-infinity'::DOUBLE) AS s FROM cl LEFT JOIN sc ON cl.name = sc.name), mx AS (SELECT c.cluster, max(abs(rho)) FILTER (WHERE NOT isnan(rho)) AS max_rho FROM pr JOIN cl c ON c.name = pr.a JOIN cl e ON e.name = pr.b AND e.cluster = c.cluster GROUP BY c.cluster)
SELECT ea.cluster, name, count(*) OVER w AS size, round(score, 4) AS score, round(max_rho, 5) AS max_rho, row_number() OVER (PARTITION BY ea.cluster ORDER BY s DESC, name DESC) = 1 AS keeper, max(s) OVER w > '-infinity'::DOUBLE AS scored FROM ea LEFT JOIN mx ON ea.cluster = mx.cluster WINDOW w AS (PARTITION BY ea.cluster)""")),
)
def _(spark, d):
    """Clusters of votes, and of each the one whose own rule (in at a vote of 1, out at -1) earned the best Sharpe ratio after costs, equally weighted."""
    v = kept(ind.votes(trade_bars(spark, d)).select("symbol", "date", "open", "high", "low", "close", "volume", *_VOTE_NAMES))
    rho = kept(stats.correlations(v, _VOTE_NAMES))
    each = v.unpivot(["symbol", "date", "open", "high", "low", "close", "volume"], _RULES, "name", "vote")
    signal = F.last(F.when(F.col("vote") == 1, 1).when(F.col("vote") == -1, 0), ignorenulls=True).over(so_far(Window.partitionBy("name", "symbol").orderBy("date")))
    run = bt.backtest(each.withColumn("signal", F.coalesce(signal, F.lit(0))), keys=("name", "symbol"))
    scores = bt.metrics(bt.equal_weight(run, keys=("name",)), "ret", ("name",), position=None).select("name", F.col("sharpe").alias("score"))
    out = stats.cluster_keepers(stats.correlation_clusters(rho, _VOTE_NAMES), rho, scores)
    return out.select("cluster", "name", "size", F.round("score", 4).alias("score"), F.round("max_rho", 5).alias("max_rho"), "keeper", "scored")


def _flag(x: str) -> str:
    return f"CAST(coalesce({x}, false) AS INTEGER)"


#: Rules of two families over ``ft``.
_FAMILY = {
    "sig_hold": "1", "sig_mom252": _flag(f"close / lag(close, 252) {_W} - 1 > 0"), "sig_macd": _flag("macd_line > macd_signal"), "sig_ema_cross": _flag("ema20 > ema50"), "sig_ema_adx": _flag("ema20 > ema50 AND adx > 25"),
    "sig_obv": _flag("obv > obv_ema"), "sig_ad": _flag("round(ad, 6) > round(ad20, 6)"), "sig_vwpm": _flag("vwpm20 > 0"),
    "sig_rsi_30_50": _state("rsi14 < 30", "rsi14 > 50", "rsi14 IS NOT NULL"), "sig_rsi_30_70": _state("rsi14 < 30", "rsi14 > 70", "rsi14 IS NOT NULL"), "sig_rsi_60_40": _state("rsi14 > 60", "rsi14 < 40", "rsi14 IS NOT NULL"),
    "sig_stoch_20_50": _state("stoch_k < 20", "stoch_k > 50", "stoch_k IS NOT NULL"), "sig_cci_100_0": _state("cci < -100", "cci > 0", "cci IS NOT NULL"), "sig_willr_80_50": _state("willr < -80", "willr > -50", "willr IS NOT NULL"),
}


@query(
    "bkt11_13_family_gate",
    with_bars(f"""{FEATURES}, ru AS MATERIALIZED (SELECT symbol, date, open, high, low, close, volume, {', '.join(f'CAST({x} AS INTEGER) AS {k}' for k, x in _FAMILY.items())} FROM ft),
sv AS (UNPIVOT ru ON {', '.join(_FAMILY)} INTO NAME rule VALUE signal), sg AS (SELECT * REPLACE (rule || ':' || symbol AS symbol) FROM sv), {_backtest_sql()},
ct AS (SELECT unnest([0.0, 0.0035, 0.007])::DOUBLE AS cost), pf AS (SELECT rule, cost, date, avg(CASE WHEN ex THEN (1 + gross) * (1 - cost) - 1 ELSE gross END) AS ret FROM eq, ct GROUP BY rule, cost, date),
q AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY rule, cost ORDER BY date) AS q FROM pf), dd AS (SELECT *, q / greatest(max(q) OVER (PARTITION BY rule, cost ORDER BY date), 1.0) - 1 AS dd FROM q)
SELECT rule, cost, round(stddev_samp(ret) * sqrt(252), 5) AS vol, round(avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0), 5) AS sharpe, round(min(dd), 5) AS max_dd, count(ret) AS n FROM dd GROUP BY rule, cost"""),
)
def _(spark, d):
    """Every rule of two families at three cost levels, one engine run over (symbol, rule, cost)."""
    df = signals.oscillator_rules(signals.simple_rules(trade_bars(spark, d)))
    names = [c for c in df.columns if c.startswith("sig_")]
    each = df.select("symbol", "date", "open", "high", "low", "close", "volume", F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("signal")) for c in names])).alias("x")).select("*", "x.*").drop("x")
    costs = spark.createDataFrame([(0.0,), (0.0035,), (0.007,)], "cost double")
    run = bt.backtest(each.crossJoin(F.broadcast(costs)), "signal", F.col("cost"), keys=("symbol", "rule", "cost"))
    port = bt.equal_weight(run, keys=("rule", "cost"))
    return rounded(bt.metrics(port, "ret", ("rule", "cost"), position=None), ["rule", "cost", "vol", "sharpe", "max_dd", "n"], 5)
