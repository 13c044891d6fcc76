"""Queries of sources, filters, joins, adjustment, calendar, universe, validation, labels and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import adjust, calendar, labels, ranges, splits
from ..operators.indicators import atr_wilder, safe_ratio
from ..sources import bars as src
from ..sources.bars import trade_bars
from .base import ACTIONS, actions, query, rounded, sql_ewm, with_bars

_W = "OVER (PARTITION BY symbol ORDER BY date)"
_HOLD = src.HOLDOUT


@query("src09_10_sealed_window", with_bars(f"SELECT symbol, date, round(close, 6) AS close, NOT (open = high AND high = low AND low = close AND volume = 0) AS tradeable FROM bars WHERE date < DATE '{_HOLD}' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"))
def _(spark, d):
    return src.window_of(src.sealed(trade_bars(spark, d)), "1996-01-01", "1998-12-31").select("symbol", "date", F.round("close", 6).alias("close"), "tradeable")


@query("src_bars", with_bars("SELECT symbol, sector, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"))
def _(spark, d):
    return trade_bars(spark, d).select("symbol", "sector", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query(
    "src_hourly_ticks",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS start, round(arg_min(value, row(ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, row(ts, event_id)), 6) AS close, count(*) AS n
FROM events GROUP BY event_type, date_trunc('hour', ts)""",
)
def _(spark, d):
    return rounded(src.tick_bars(spark, d), ["symbol", "start", "open", "high", "low", "close", "n"])


@query("src04_finished_bars", with_bars("SELECT symbol, count(*) AS n, max(date) AS last FROM bars WHERE date < (SELECT max(date) FROM bars) GROUP BY symbol"))
def _(spark, d):
    b = trade_bars(spark, d)
    today = b.agg(F.max("date").alias("today"))
    return src.finished_bars(b.crossJoin(F.broadcast(today)), F.col("today")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))


@query("src07_actions", f"WITH {ACTIONS} SELECT symbol, ex_date, action_type, ratio, dividend_amount, confidence FROM actions")
def _(spark, d):
    raw = actions(spark).select(*[F.concat(F.lit(" "), F.col(c).cast("string")).alias(c) for c in ("symbol", "ex_date", "action_type", "ratio", "dividend_amount", "confidence")])
    return src.normalised_actions(raw).select("symbol", "ex_date", "action_type", "ratio", "dividend_amount", "confidence")


@query(
    "src08_actions_from_tags",
    f"WITH {ACTIONS}, t AS (SELECT symbol, ex_date, string_agg(DISTINCT action_type, ';') AS tags FROM actions GROUP BY symbol, ex_date) SELECT symbol, ex_date, unnest(string_split(tags, ';')) AS action_type FROM t",
)
def _(spark, d):
    tags = actions(spark).groupBy("symbol", F.col("ex_date").alias("date")).agg(F.array_join(F.array_sort(F.collect_set("action_type")), "; ").alias("CorpActionTypes"))
    return src.actions_from_tags(tags)


@query("src16_duplicate_keys", "SELECT l_orderkey AS order_key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _(spark, d):
    items = src.table(spark, d, "lineitem")
    return items.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("l_orderkey").alias("order_key"), "n")


@query("src03_first_success", "SELECT o_orderpriority AS name, min(o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def _(spark, d):
    tries = src.table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("rank"), F.when(F.col("o_orderstatus") == "F", "OK").otherwise("FAILED").alias("status"))
    return src.first_success(tries).select("name", "rank")


@query("src02_keep_last", "SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return src.table(spark, d, "events").withColumn("n", F.row_number().over(last)).where("n = 1").select("user_id", "event_id")


@query("src12_business_days", "SELECT event_id, CAST(DATE '2000-01-03' + CAST(i + 2 * (i // 5) AS INTEGER) AS DATE) AS date FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)")
def _(spark, d):
    return src.with_date(src.table(spark, d, "events").select("event_id"), "event_id").select("event_id", "date")


@query(
    "flt01_02_03_action_filters",
    f"""WITH {ACTIONS}, last AS (SELECT max(CAST(l_shipdate AS DATE)) AS d FROM lineitem)
SELECT symbol, ex_date, action_type, coalesce(ratio >= 1, false) AS usable, action_type IN ('split', 'bonus', 'demerger', 'rights') AND NOT coalesce(ratio >= 1, false) AS uncrossable, contains(confidence, 'RATIO_APPROX') AS approx, contains(confidence, 'DERIVED') AS derived,
  action_type IN ('rights', 'demerger') AND coalesce(ratio >= 1, false) AS volume_unhandled FROM actions""",
)
def _(spark, d):
    a = actions(spark)
    key = ["symbol", "ex_date", "action_type"]
    out = a.withColumn("usable", adjust.usable(F.col("ratio")))
    for name, f in (("uncrossable", adjust.uncrossable), ("approx", adjust.approximate), ("derived", adjust.derived_dates), ("volume_unhandled", adjust.volume_unhandled)):
        out = out.join(f(a).select(*key, F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select(*key, "usable", "uncrossable", "approx", "derived", "volume_unhandled")


@query("flt03_pending_actions", with_bars(f"{ACTIONS}, l AS (SELECT symbol, max(date) AS d FROM bars GROUP BY symbol) SELECT a.symbol, ex_date, action_type FROM actions a JOIN l ON a.symbol = l.symbol WHERE ex_date > l.d"))
def _(spark, d):
    return adjust.pending(trade_bars(spark, d), actions(spark)).select("symbol", "ex_date", "action_type")


@query("flt04_05_06_bad_bars", with_bars("SELECT symbol, date, CASE WHEN volume > 5 THEN round(close, 6) END AS close, CASE WHEN volume > 5 THEN volume END AS volume FROM bars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0"))
def _(spark, d):
    b = calendar.stale_or_bad(trade_bars(spark, d)).withColumn("volume", F.when(F.col("volume") > 5, F.col("volume")).otherwise(0.0))
    return calendar.blanked(b).select("symbol", "date", F.round("close", 6).alias("close"), "volume")


@query("flt07_eligible", with_bars(f"SELECT symbol, date, count(close) {_W} >= 273 AND close IS NOT NULL AS eligible FROM bars"))
def _(spark, d):
    return calendar.eligible(trade_bars(spark, d)).select("symbol", "date", "eligible")


@query("flt08_sessions", with_bars("SELECT date FROM bars GROUP BY date HAVING count(*) FILTER (WHERE volume > 20) * 1.0 / count(*) > 0.5"))
def _(spark, d):
    return calendar.sessions_by_share(trade_bars(spark, d).withColumn("volume", F.greatest(F.col("volume") - 20, F.lit(0.0))))


@query(
    "flt09_jump_guard",
    with_bars(f"r AS (SELECT symbol, date, abs(close / lag(close) {_W} - 1) AS m FROM bars), g AS (SELECT symbol, date, max(m) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS x FROM r) SELECT symbol, date FROM g WHERE coalesce(x, 0) <= 1.2"),
)
def _(spark, d):
    return calendar.jump_guarded(trade_bars(spark, d), 20, 1.2).select("symbol", "date")


@query("prj02_03_06_cases_and_windows", with_bars("""SELECT symbol, date, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS kind, round(ln(close / CASE WHEN volume IS NULL OR volume = 0 THEN 1 ELSE volume END), 6) AS safe,
  len(list(close) OVER f) AS n, round(list_sum(list(close) OVER f), 4) AS total FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 12 FOLLOWING)"""))
def _(spark, d):
    around = F.collect_list(F.struct("date", "close")).over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-5, 12))
    kind = F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat")
    df = trade_bars(spark, d).withColumn("w", around)
    return df.select("symbol", "date", kind.alias("kind"), F.round(F.log(safe_ratio(F.col("close"), F.col("volume"))), 6).alias("safe"), F.size("w").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x["close"]), 4).alias("total"))


@query("prj05_flag_dates", with_bars("""x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'), d AS (SELECT DISTINCT date FROM bars)
SELECT 'flagged' AS kind, date FROM d WHERE date IN (SELECT date FROM x) UNION ALL SELECT 'missing', date FROM x WHERE date NOT IN (SELECT date FROM d)"""))
def _(spark, d):
    x = src.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("date"))
    dates, missing = calendar.flagged(trade_bars(spark, d).select("date").distinct(), x, "on")
    return dates.where("on = 1").select(F.lit("flagged").alias("kind"), "date").unionByName(missing.select(F.lit("missing").alias("kind"), "date"))


@query("joi07_cal02_aligned", with_bars("""d AS (SELECT DISTINCT date FROM bars), l AS (SELECT symbol, min(date) AS a, max(date) AS z FROM bars GROUP BY symbol)
SELECT l.symbol, d.date, round(b.close, 6) AS close, b.close IS NULL AND d.date <= l.z AS no_data, d.date > l.z AS post_delisting FROM l JOIN d ON d.date >= l.a LEFT JOIN bars b ON b.symbol = l.symbol AND b.date = d.date"""))
def _(spark, d):
    b = trade_bars(spark, d)
    return calendar.aligned(b, calendar.trading_calendar(b)).select("symbol", "date", F.round("close", 6).alias("close"), "no_data", "post_delisting")


@query("joi10_asof_forward", with_bars(f"{ACTIONS} SELECT symbol, ex_date, action_type, (SELECT min(date) FROM bars b WHERE b.symbol = a.symbol AND b.date >= a.ex_date) AS anchor FROM actions a"))
def _(spark, d):
    return adjust.anchored(trade_bars(spark, d), actions(spark).select("symbol", "ex_date", "action_type"))


@query("joi11_asof_backward", with_bars("""q AS (SELECT symbol, CAST(date + 1 AS DATE) AS date FROM bars), v AS (SELECT symbol, date, close AS px FROM bars WHERE close > open)
SELECT q.symbol, q.date, round(CASE WHEN q.date - v.date <= 30 THEN v.px END, 6) AS px FROM q ASOF LEFT JOIN v ON q.symbol = v.symbol AND q.date >= v.date"""))
def _(spark, d):
    b = trade_bars(spark, d)
    q = b.select("symbol", F.date_add("date", 1).alias("date"))
    v = b.where("close > open").select("symbol", "date", F.col("close").alias("px"))
    return adjust.as_of_backward(q, v, "px", 30).select("symbol", "date", F.round("px", 6).alias("px"))


@query("joi12_session_offset", with_bars("""c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM bars)), x AS (SELECT symbol, min(date) AS first FROM bars GROUP BY symbol)
SELECT symbol, first, (SELECT date FROM c WHERE n = least((SELECT n FROM c WHERE date = first) + 210, (SELECT max(n) FROM c))) AS later FROM x"""))
def _(spark, d):
    b = trade_bars(spark, d)
    first = b.groupBy("symbol").agg(F.min("date").alias("first"))
    return calendar.session_offset(first, calendar.trading_calendar(b), "first", 210, "later").select("symbol", "first", "later")


@query("joi13_18_purged", with_bars(f"{ACTIONS} SELECT symbol, count(*) AS n FROM bars b WHERE EXISTS (SELECT 1 FROM actions a WHERE a.symbol = b.symbol AND a.action_type <> 'dividend' AND b.date BETWEEN a.ex_date - 18 AND a.ex_date) GROUP BY symbol"))
def _(spark, d):
    p = calendar.purge_windows(actions(spark)).select("symbol", "start", "stop")
    return ranges.within(trade_bars(spark, d), p, ["symbol"], "date", "start", "stop", 32, "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("joi14_val07_uncovered_moves", with_bars(f"{ACTIONS}, m AS (SELECT symbol, date, close / lag(close) {_W} - 1 AS move FROM bars) SELECT symbol, date, round(move, 6) AS move FROM m WHERE abs(move) >= 0.15 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.symbol = m.symbol AND abs(date_diff('day', m.date, a.ex_date)) <= 3)"))
def _(spark, d):
    return rounded(calendar.uncovered_moves(trade_bars(spark, d), actions(spark)), ["symbol", "date", "move"])


@query("joi19_peers", with_bars(f"""r AS (SELECT symbol, sector, date, close / lag(close, 5) {_W} - 1 AS r FROM bars)
SELECT a.symbol, a.date, round(a.r - avg(b.r), 6) AS rel FROM r a JOIN r b ON a.date = b.date AND a.sector = b.sector AND a.symbol <> b.symbol WHERE a.r IS NOT NULL GROUP BY a.symbol, a.date, a.r"""))
def _(spark, d):
    r = trade_bars(spark, d).withColumn("r", F.col("close") / F.lag("close", 5).over(Window.partitionBy("symbol").orderBy("date")) - 1)
    w = Window.partitionBy("date", "sector")
    n = F.count("r").over(w) - F.col("r").isNotNull().cast("int")
    rows = F.count(F.lit(1)).over(w)
    df = r.withColumn("n", n).withColumn("rows", rows).withColumn("t", F.sum("r").over(w)).where("r is not null and rows > 1")
    return df.select("symbol", "date", F.round(F.when(F.col("n") > 0, F.col("r") - (F.col("t") - F.col("r")) / F.col("n")), 6).alias("rel"))


@query("joi21_23_full_outer", "SELECT coalesce(a.k, b.k) AS k, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT o_custkey AS k, count(*) AS na FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS nb FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def _(spark, d):
    o = src.table(spark, d, "orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(n))
    return side("F", "na").join(side("O", "nb"), "k", "full").na.fill(0, ["na", "nb"])


@query("joi01_04_inner_left", """SELECT o.o_orderkey AS k, c_mktsegment AS seg, round(coalesce(s.total, 0), 4) AS total FROM orders o JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) s ON s.l_orderkey = o.o_orderkey""")
def _(spark, d):
    s = src.table(spark, d, "lineitem").where("l_discount > 0.05").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    j = src.table(spark, d, "orders").join(src.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.select(F.col("o_orderkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


_ANCHORS = f"""{ACTIONS}, ok AS (SELECT * FROM actions WHERE action_type <> 'dividend' AND coalesce(ratio >= 1, false)),
n AS (SELECT symbol, date, lag(close) {_W} / close AS observed FROM bars),
per AS (SELECT symbol, ex_date, product(ratio) AS r_all, product(ratio) FILTER (WHERE action_type = 'split') AS r_split FROM ok GROUP BY symbol, ex_date),
anc AS (SELECT per.*, (SELECT min(date) FROM bars b WHERE b.symbol = per.symbol AND b.date >= per.ex_date) AS anchor FROM per),
obs AS (SELECT anc.*, n.observed FROM anc LEFT JOIN n ON anc.symbol = n.symbol AND anc.anchor = n.date),
cand AS (SELECT symbol, ex_date, observed, 'NOT_FOLDED' AS k, r_all AS v FROM obs UNION ALL SELECT symbol, ex_date, observed, 'PREFOLDED', r_all / r_split FROM obs WHERE r_split IS NOT NULL
  UNION ALL SELECT symbol, ex_date, observed, 'FULLY_PREFOLDED', 1.0 FROM obs WHERE least(abs(r_all - 1), coalesce(abs(r_all / r_split - 1), 9)) >= 1e-9),
v AS (SELECT symbol, ex_date, CASE WHEN max(observed) IS NULL THEN 'INSUFFICIENT_DATA' WHEN (max(v) - min(v)) / min(v) < 0.25 THEN 'NOT_DISTINGUISHABLE' WHEN count(*) FILTER (WHERE abs(observed / v - 1) <= 0.1) = 1 THEN max(k) FILTER (WHERE abs(observed / v - 1) <= 0.1) ELSE 'AMBIGUOUS' END AS verdict,
  CASE WHEN max(observed) IS NOT NULL THEN arg_min(k, row(abs(ln(observed) - ln(v)), k)) END AS closest FROM cand GROUP BY symbol, ex_date)"""


@query("adj01_02_verdicts", with_bars(f"{_ANCHORS} SELECT obs.symbol, obs.ex_date, round(r_all, 6) AS r_all, round(observed, 6) AS observed, verdict, closest FROM obs JOIN v ON obs.symbol = v.symbol AND obs.ex_date = v.ex_date"))
def _(spark, d):
    return rounded(adjust.folded(trade_bars(spark, d), actions(spark)), ["symbol", "ex_date", "r_all", "observed", "verdict", "closest"])


def _divisor_sql(policy: str) -> str:
    use = {
        "always": "SELECT ok.* FROM ok", "never": "SELECT ok.* FROM ok WHERE action_type <> 'split'",
        "auto": "SELECT ok.* FROM ok JOIN v ON ok.symbol = v.symbol AND ok.ex_date = v.ex_date WHERE CASE WHEN verdict = 'AMBIGUOUS' THEN closest ELSE verdict END = 'NOT_FOLDED' OR (CASE WHEN verdict = 'AMBIGUOUS' THEN closest ELSE verdict END = 'PREFOLDED' AND action_type <> 'split')",
    }[policy]
    return f"""{_ANCHORS}, used AS ({use}), at AS (SELECT *, (SELECT min(date) FROM bars b WHERE b.symbol = used.symbol AND b.date >= used.ex_date) AS anchor FROM used)
SELECT b.symbol, b.date, round(coalesce((SELECT product(ratio) FROM at a WHERE a.symbol = b.symbol AND a.anchor > b.date), 1), 6) AS divisor,
  round(coalesce((SELECT product(ratio) FROM at a WHERE a.symbol = b.symbol AND a.anchor > b.date AND a.action_type IN ('split', 'bonus')), 1), 6) AS share_ratio FROM bars b""".replace(" at AS", " placed AS").replace("FROM at a", "FROM placed a")


for _policy in ("always", "never", "auto"):

    def _run(spark, d, policy=_policy):
        return rounded(adjust.with_divisors(trade_bars(spark, d), actions(spark), policy), ["symbol", "date", "divisor", "share_ratio"])

    query(f"adj03_04_divisors_{_policy}", with_bars(_divisor_sql(_policy)))(_run)


@query("adj05_06_08_adjusted")
def _(spark, d):
    names = ["symbol", "date", "adj_open", "adj_high", "adj_low", "adj_close", "adj_volume", "dividend_raw", "dividend", "action_types", "approx_ratio", "ambiguous", "uncrossable", "date_uncertain", "segment_id", "quality"]
    return rounded(adjust.adjusted(trade_bars(spark, d), actions(spark), "always"), names)


@query("adj08_segments", with_bars(f"{ACTIONS} SELECT b.symbol, b.date, (SELECT count(DISTINCT ex_date) FROM actions a WHERE a.symbol = b.symbol AND action_type <> 'dividend' AND NOT coalesce(ratio >= 1, false) AND ex_date <= b.date) AS segment_id FROM bars b"))
def _(spark, d):
    return adjust.with_quality(trade_bars(spark, d), actions(spark)).select("symbol", "date", "segment_id")


@query("adj06_dividends", with_bars(f"{ACTIONS} SELECT b.symbol, b.date, round(sum(dividend_amount), 6) AS dividend FROM actions a JOIN bars b ON a.symbol = b.symbol WHERE action_type = 'dividend' AND b.date = (SELECT min(date) FROM bars c WHERE c.symbol = a.symbol AND c.date >= a.ex_date) GROUP BY b.symbol, b.date"))
def _(spark, d):
    df = adjust.with_dividends(trade_bars(spark, d).withColumn("divisor", F.lit(1.0)), actions(spark)).where("dividend > 0")
    return rounded(df, ["symbol", "date", "dividend"])


@query("adj07_13_implied_dividends", with_bars(f"""{ACTIONS}, f AS (SELECT *, CASE WHEN date >= DATE '1998-01-05' THEN 1.0 ELSE 0.95 END AS f FROM bars), g AS (SELECT symbol, date, 1 - lag(f) {_W} / f AS y, lag(close) {_W} AS pc, row_number() {_W} AS i FROM f),
x AS (SELECT DISTINCT a.symbol, (SELECT min(date) FROM bars b WHERE b.symbol = a.symbol AND b.date >= a.ex_date) AS d FROM actions a WHERE action_type <> 'dividend' AND coalesce(ratio >= 1, false)), xi AS (SELECT g.symbol, g.i FROM x JOIN g ON x.symbol = g.symbol AND x.d = g.date)
SELECT symbol, date, round(y * pc, 6) AS cash FROM g WHERE y > 1e-4 AND y <= 0.25 AND NOT EXISTS (SELECT 1 FROM xi WHERE xi.symbol = g.symbol AND abs(xi.i - g.i) <= 1)"""))
def _(spark, d):
    b = trade_bars(spark, d).withColumn("adj_close", F.col("close") * F.when(F.col("date") >= "1998-01-05", 1.0).otherwise(0.95))
    return rounded(adjust.implied_dividends(b, actions(spark)), ["symbol", "date", "cash"])


@query("adj09_residual_jumps", with_bars(f"{ACTIONS}, m AS (SELECT symbol, date, close / lag(close) {_W} - 1 AS move FROM bars) SELECT symbol, date, round(move, 6) AS move FROM m WHERE abs(move) > 0.9 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.symbol = m.symbol AND action_type <> 'dividend' AND (SELECT min(date) FROM bars b WHERE b.symbol = a.symbol AND b.date >= a.ex_date) = m.date)"))
def _(spark, d):
    b = trade_bars(spark, d).withColumn("adj_close", F.col("close"))
    return rounded(adjust.residual_jumps(b, actions(spark), 0.9), ["symbol", "date", "move"])


_ART = "art AS (SELECT symbol, min(date) AS date FROM bars WHERE date >= DATE '1998-01-01' GROUP BY symbol)"


@query("adj10_11_repaired", with_bars(f"""{_ART}, idx AS (SELECT date, avg(close) AS level FROM bars GROUP BY date), n AS (SELECT b.symbol, b.date, b.close, lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.date) AS pc, idx.level, lag(idx.level) OVER (PARTITION BY b.symbol ORDER BY b.date) AS pl FROM bars b JOIN idx ON b.date = idx.date),
f AS (SELECT n.symbol, n.date, close / pc / (level / pl) AS f FROM n JOIN art ON n.symbol = art.symbol AND n.date = art.date)
SELECT b.symbol, b.date, round(ln(b.close * coalesce((SELECT f.f FROM f WHERE f.symbol = b.symbol AND f.date > b.date), 1)), 6) AS close FROM bars b"""))
def _(spark, d):
    b = trade_bars(spark, d)
    art = b.where("date >= '1998-01-01'").groupBy("symbol").agg(F.min("date").alias("date"))
    idx = b.groupBy("date").agg(F.avg("close").alias("level"))
    return rounded(adjust.repaired(b, art, idx).withColumn("close", F.log("close")), ["symbol", "date", "close"])


@query("adj12_total_return_open", with_bars("SELECT symbol, date, round(open * (close * 1.1 / close), 6) AS ao FROM bars"))
def _(spark, d):
    return trade_bars(spark, d).select("symbol", "date", F.round(adjust.total_return_open(F.col("open"), F.col("close"), F.col("close") * 1.1), 6).alias("ao"))


@query("cal01_agg27_calendar", with_bars("d AS (SELECT DISTINCT date FROM bars), g AS (SELECT date, date - lag(date) OVER (ORDER BY date) AS gap FROM d) SELECT count(*) AS sessions, count(*) - count(DISTINCT date) AS duplicates, count(*) FILTER (WHERE isodow(date) >= 6) AS weekends, count(*) FILTER (WHERE gap > 6) AS long_gaps, max(gap) AS longest_gap FROM g"))
def _(spark, d):
    return calendar.calendar_report(calendar.trading_calendar(trade_bars(spark, d)))


@query("agg26_index_audit", with_bars("d AS (SELECT DISTINCT date FROM bars) SELECT symbol, count(*) AS n, count(*) - count(DISTINCT date) AS duplicates, count(*) FILTER (WHERE close IS NULL) AS missing_closes, count(*) FILTER (WHERE isodow(date) >= 6) AS weekends, (SELECT count(*) FROM d) - count(DISTINCT date) AS missing_sessions FROM bars GROUP BY symbol"))
def _(spark, d):
    b = trade_bars(spark, d)
    return calendar.index_audit(b, calendar.trading_calendar(b))


@query("uni01_purge_windows", f"WITH {ACTIONS} SELECT DISTINCT symbol, CAST(ex_date - 18 AS DATE) AS start, ex_date AS stop FROM actions WHERE action_type <> 'dividend'")
def _(spark, d):
    return calendar.purge_windows(actions(spark))


@query("uni02_embargo", with_bars("c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM bars)), b AS (SELECT unnest([DATE '1997-06-02', DATE '1999-01-04']) AS boundary) SELECT boundary, (SELECT date FROM c WHERE n = (SELECT n FROM c WHERE date = boundary) - 10) AS start, (SELECT date FROM c WHERE n = (SELECT n FROM c WHERE date = boundary) + 10) AS stop FROM b"))
def _(spark, d):
    b = spark.createDataFrame([("1997-06-02",), ("1999-01-04",)], "b string").select(F.to_date("b").alias("boundary"))
    return calendar.embargo_windows(b, calendar.trading_calendar(trade_bars(spark, d)))


@query("uni03_universe", with_bars(f"""{ACTIONS}, c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM bars)), l AS (SELECT symbol, min(date) AS first_bar, max(date) AS last_bar FROM bars GROUP BY symbol),
x AS (SELECT symbol, first_bar, last_bar, count(*) AS total_sessions, CAST(count(*) FILTER (WHERE c.date < DATE '1995-09-01') AS BIGINT) AS pre, min(n) + 220 AS e FROM l JOIN c ON c.date BETWEEN first_bar AND last_bar GROUP BY 1, 2, 3)
SELECT x.symbol, first_bar, last_bar, total_sessions, pre AS pre_holdout_sessions, c.date AS eligible_from, (SELECT min(ex_date) FROM actions a WHERE a.symbol = x.symbol AND action_type = 'demerger' AND (ratio IS NULL OR coalesce(confidence = 'UNVERIFIED', false))) AS truncate_at, greatest(total_sessions - 220, 0) AS n_samples,
  CASE WHEN x.symbol = 'NATION_9' THEN 'demerger_child_overlaps_parent' WHEN first_bar >= DATE '1995-09-01' THEN 'holdout_only_listing' WHEN pre < 220 THEN 'insufficient_history' END AS exclude_reason FROM x LEFT JOIN c ON c.n = x.e"""))
def _(spark, d):
    b = trade_bars(spark, d)
    u = calendar.universe(b, actions(spark), calendar.trading_calendar(b), "1995-09-01", children=("NATION_9",))
    return u.select("symbol", "first_bar", "last_bar", "total_sessions", "pre_holdout_sessions", "eligible_from", "truncate_at", "n_samples", "exclude_reason")


@query("val08_label_check", "SELECT 'x' AS symbol, DATE '2000-01-01' AS date, 'x' AS problem WHERE false")
def _(spark, d):
    b = trade_bars(spark, d)
    return calendar.label_check(labels.triple_barrier(b), b)


@query("uni04_05_pit_universe", with_bars("""v AS (SELECT symbol, date, list(close * volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS l FROM bars), m AS (SELECT symbol, date, CASE WHEN len(l) >= 60 THEN list_aggregate(l, 'quantile_cont', 0.5) END AS m FROM v),
k AS (SELECT symbol, date, CASE WHEN m IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY m DESC NULLS LAST) END AS r FROM m) SELECT symbol, date, r AS turnover_rank, coalesce(r <= 10, false) AS in_universe FROM k"""))
def _(spark, d):
    return calendar.turnover_universe(trade_bars(spark, d)).select("symbol", "date", "turnover_rank", "in_universe")


@query("val01_06_violations", with_bars("""x AS (SELECT *, CASE WHEN day(date) = 3 THEN low - 1 ELSE high END AS h2, CASE WHEN day(date) = 5 THEN -1.0 ELSE close END AS c2 FROM bars), b AS (SELECT symbol, date, open, h2 AS high, low, c2 AS close FROM x)
SELECT symbol, date, 'high_below_body' AS rule FROM b WHERE high + 1e-6 < greatest(open, close) UNION ALL SELECT symbol, date, 'low_above_body' FROM b WHERE low - 1e-6 > least(open, close) UNION ALL SELECT symbol, date, 'high_below_low' FROM b WHERE high + 1e-6 < low
UNION ALL SELECT symbol, date, 'price_not_positive' FROM b WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0"""))
def _(spark, d):
    b = trade_bars(spark, d)
    bad = b.withColumn("high", F.when(F.dayofmonth("date") == 3, F.col("low") - 1).otherwise(F.col("high"))).withColumn("close", F.when(F.dayofmonth("date") == 5, -1.0).otherwise(F.col("close")))
    return calendar.violations(bad, calendar.trading_calendar(b)).where("rule <> 'identical_run'")


@query("val09_10_validation", with_bars(f"""{ACTIONS}, m AS (SELECT symbol, date, close / lag(close) {_W} - 1 AS move FROM bars), u AS (SELECT symbol, count(*) AS uncaught FROM m WHERE abs(move) >= 0.15 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.symbol = m.symbol AND abs(date_diff('day', m.date, a.ex_date)) <= 3) GROUP BY symbol)
SELECT b.symbol, 0 AS problems, coalesce(uncaught, 0) AS uncaught, true AS passed FROM (SELECT DISTINCT symbol FROM bars) b LEFT JOIN u ON b.symbol = u.symbol"""))
def _(spark, d):
    b = trade_bars(spark, d)
    return calendar.validation(b, calendar.trading_calendar(b), actions(spark)).select("symbol", "problems", "uncaught", "passed")


_LABELS = f"""tr AS (SELECT *, CASE WHEN lag(close) {_W} IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) {_W}), abs(low - lag(close) {_W})) END AS tr, row_number() {_W} AS i FROM bars),
a AS (SELECT *, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr, count(*) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS ahead FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
t AS (SELECT a.symbol, a.date, min(b.i) AS ti FROM a JOIN a b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 10 WHERE b.high >= a.close + 2 * a.atr OR b.low <= a.close - a.atr GROUP BY a.symbol, a.date),
lab AS (SELECT a.symbol, a.date, a.atr, a.close + 2 * a.atr AS ub, a.close - a.atr AS lb, x.date AS td, CASE WHEN a.atr IS NULL THEN 'insufficient_atr_warmup' WHEN a.ahead < 10 THEN 'insufficient_forward_window' END AS reason,
  CASE WHEN x.date IS NULL THEN 'Sideways' WHEN x.low <= a.close - a.atr THEN 'Down' ELSE 'Up' END AS l FROM a LEFT JOIN t ON a.symbol = t.symbol AND a.date = t.date LEFT JOIN a x ON x.symbol = t.symbol AND x.i = t.ti)"""


@query("lab01_02_triple_barrier", with_bars(f"{_LABELS} SELECT symbol, date, CASE WHEN reason IS NULL THEN l END AS label, CASE WHEN reason IS NULL THEN td END AS touch_date, round(atr, 6) AS atr, round(ub, 6) AS upper_barrier, round(lb, 6) AS lower_barrier, reason AS dropped_reason FROM lab"))
def _(spark, d):
    return rounded(labels.triple_barrier(trade_bars(spark, d)), ["symbol", "date", "label", "touch_date", "atr", "upper_barrier", "lower_barrier", "dropped_reason"])


@query("lab02_purged_labels", with_bars(f"""{_LABELS}, {ACTIONS}, pw AS (SELECT DISTINCT symbol, CAST(ex_date - 18 AS DATE) AS start, ex_date AS stop FROM actions WHERE action_type <> 'dividend'), cu AS (SELECT symbol, ex_date AS cut FROM actions WHERE action_type = 'demerger'),
en AS (SELECT symbol, date, lead(date, 10) {_W} AS stop FROM bars), z AS (SELECT lab.symbol, lab.date, reason, l, en.stop, cut, EXISTS (SELECT 1 FROM pw WHERE pw.symbol = lab.symbol AND lab.date BETWEEN pw.start AND pw.stop) AS p FROM lab JOIN en ON lab.symbol = en.symbol AND lab.date = en.date LEFT JOIN cu ON lab.symbol = cu.symbol),
y AS (SELECT l, CASE WHEN date >= cut THEN 'post_truncate' WHEN p THEN 'purge_window' WHEN reason IS NOT NULL THEN reason WHEN stop >= cut THEN 'crosses_truncate' END AS why FROM z) SELECT why AS dropped_reason, CASE WHEN why IS NULL THEN l END AS label, count(*) AS n FROM y GROUP BY 1, 2"""))
def _(spark, d):
    a = actions(spark)
    cut = a.where("action_type = 'demerger'").select("symbol", F.col("ex_date").alias("truncate_at"))
    return labels.triple_barrier(trade_bars(spark, d), purge=calendar.purge_windows(a), truncate=cut).groupBy("dropped_reason", "label").agg(F.count(F.lit(1)).alias("n"))


@query("agg03_label_counts", with_bars(f"{_LABELS} SELECT l AS label, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM lab WHERE reason IS NULL GROUP BY l"))
def _(spark, d):
    n = labels.triple_barrier(trade_bars(spark, d)).where("dropped_reason is null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("lab03_panel_barrier", with_bars(f"""t AS (SELECT *, CASE WHEN lag(close) {_W} IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) {_W}), abs(low - lag(close) {_W})) END AS tr, row_number() {_W} - 1 AS i FROM bars), a AS (SELECT *, {sql_ewm('tr', 1 / 14)} AS atr FROM t),
e AS (SELECT symbol, date, i, lead(open) {_W} + 2 * atr AS u, lead(open) {_W} - atr AS dn, lead(close, 10) {_W} AS c FROM a), h AS (SELECT e.symbol, e.date, min(b.i) AS k FROM e JOIN a b ON e.symbol = b.symbol AND b.i BETWEEN e.i + 1 AND e.i + 10 WHERE b.high >= e.u OR b.low <= e.dn GROUP BY e.symbol, e.date),
l AS (SELECT e.symbol, CASE WHEN e.c IS NULL OR e.u IS NULL THEN NULL WHEN h.k IS NULL THEN 0 WHEN b.low <= e.dn THEN -1 ELSE 1 END AS lab FROM e LEFT JOIN h ON e.symbol = h.symbol AND e.date = h.date LEFT JOIN a b ON b.symbol = h.symbol AND b.i = h.k) SELECT symbol, lab, count(*) AS n FROM l GROUP BY symbol, lab"""))
def _(spark, d):
    return labels.panel_barrier(atr_wilder(trade_bars(spark, d), 14, "atr")).groupBy("symbol", "lab").agg(F.count(F.lit(1)).alias("n"))


@query("lab04_outcomes")
def _(spark, d):
    df = labels.outcomes(atr_wilder(trade_bars(spark, d), 14, "atr"))
    return rounded(df, ["symbol", "date", "out_win", "out_day", "out_ret"])


@query("lab06_07_forward_returns", with_bars(f"""f AS (SELECT symbol, date, lead(close, 22) {_W} / lead(close, 1) {_W} - 1 AS r FROM bars), g AS (SELECT *, avg(r) OVER (PARTITION BY date) AS m, quantile_cont(r, 0.5) OVER (PARTITION BY date) AS med, count(r) OVER (PARTITION BY date) AS n, count(r) OVER (PARTITION BY date, r) AS ties, rank() OVER (PARTITION BY date ORDER BY r NULLS LAST) AS k FROM f)
SELECT symbol, date, round(r, 6) AS fwd_ret, round(r - m, 6) AS fwd_excess, round(CASE WHEN r IS NOT NULL THEN (k + (ties - 1) / 2.0) / n - 0.5 END, 6) AS y_rank, CASE WHEN r IS NOT NULL THEN CAST(r > med AS INTEGER) END AS y_up FROM g"""))
def _(spark, d):
    return rounded(labels.forward_return(trade_bars(spark, d)), ["symbol", "date", "fwd_ret", "fwd_excess", "y_rank", "y_up"])


#: Test ranges of the walk-forward folds on this panel (fixed values).
RANGES = (("1997-01-01", "1997-12-31"), ("1998-01-01", "1998-12-31"), ("1999-01-01", "1999-12-31"), ("2000-01-01", "2000-12-31"))


def fold_ranges(spark):
    rows = [(k + 1, a, b) for k, (a, b) in enumerate(RANGES)]
    return spark.createDataFrame(rows, "fold int, a string, b string").select("fold", F.to_date("a").alias("test_start"), F.to_date("b").alias("test_end"))


_CAL = "c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM bars))"
_KEPT = f"""{_LABELS}, {_CAL}, lk AS MATERIALIZED (SELECT CAST(substr(symbol, 8) AS INTEGER) AS k, date, td FROM lab WHERE reason IS NULL),
c10 AS MATERIALIZED (SELECT date, coalesce(lead(date, 10) OVER (ORDER BY date), max(date) OVER ()) AS e FROM c), w AS MATERIALIZED (SELECT k, lk.date, greatest(lk.date, coalesce(td, e)) AS we FROM lk JOIN c10 ON lk.date = c10.date),
r0 AS (SELECT * FROM (VALUES {', '.join(f"({k + 1}, DATE '{a}', DATE '{b}')" for k, (a, b) in enumerate(RANGES))}) AS v(fold, a, b)),
r AS (SELECT fold, a, b, coalesce((SELECT date FROM c WHERE n = least((SELECT n FROM c WHERE date = b) + 10, (SELECT max(n) FROM c))), CAST(b + 20 AS DATE)) AS s FROM r0)"""


def _folds_sql(inside: str) -> str:
    return with_bars(f"""{_KEPT}, f AS (SELECT fold, 1 AS test, k, date FROM w, r WHERE date BETWEEN a AND b AND we <= b
UNION ALL (SELECT r.fold, 0, k, date FROM w, r WHERE we < r.a EXCEPT SELECT r.fold, 0, k, date FROM w, r, r p WHERE p.fold < r.fold AND {inside})),
n AS (SELECT fold, test, k, count(*) AS n, min(date) AS first, max(date) AS last FROM f GROUP BY fold, test, k)
SELECT fold, CASE WHEN test = 1 THEN 'test' ELSE 'train' END AS role, 'NATION_' || k AS symbol, n, first, last FROM n""")


for _rule, _inside in (("embargo_shadow", "w.date > p.b AND w.date <= p.s"), ("drop_all_after_prior_test", "w.date > p.b")):

    def _run(spark, d, rule=_rule):
        b = trade_bars(spark, d)
        cal = calendar.trading_calendar(b)
        kept = splits.with_window_end(labels.triple_barrier(b).where("dropped_reason is null"), cal)
        f = splits.folds(kept, fold_ranges(spark), cal, rule=rule)
        return f.groupBy("fold", "role", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))

    query(f"spl02_03_folds_{_rule}", _folds_sql(_inside))(_run)


@query("spl01_window_end", with_bars(f"{_KEPT} SELECT 'NATION_' || k AS symbol, date, we AS window_end FROM w"))
def _(spark, d):
    b = trade_bars(spark, d)
    return splits.with_window_end(labels.triple_barrier(b).where("dropped_reason is null"), calendar.trading_calendar(b)).select("symbol", "date", "window_end")


@query("spl_overlap_check", "SELECT 1 AS fold, 'x' AS symbol, DATE '2000-01-01' AS date WHERE false")
def _(spark, d):
    b = trade_bars(spark, d)
    cal = calendar.trading_calendar(b)
    return splits.overlap(splits.folds(splits.with_window_end(labels.triple_barrier(b).where("dropped_reason is null"), cal), fold_ranges(spark), cal))


@query("spl04_calibration_slice", with_bars(f"""{_KEPT}, u AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8) AS c FROM (SELECT DISTINCT date FROM w)), v AS (SELECT CAST(DATE '1970-01-01' + CAST(floor(c) AS INTEGER) AS DATE) AS cut FROM u)
SELECT CASE WHEN date > cut THEN 'calib' WHEN we <= cut THEN 'fit' END AS part, count(*) AS n, min(date) AS first, max(date) AS last FROM w, v GROUP BY 1"""))
def _(spark, d):
    b = trade_bars(spark, d)
    kept = splits.with_window_end(labels.triple_barrier(b).where("dropped_reason is null"), calendar.trading_calendar(b))
    return splits.calibration_slice(kept).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("spl05_06_combinatorial")
def _(spark, d):
    b = trade_bars(spark, d).select("symbol", "date")
    dates = splits.date_blocks(b, 6)
    plan, held = splits.combinatorial_plan(spark, [f"NATION_{i}" for i in range(25)], 6, 2, 2)
    return splits.combinatorial_roles(b, plan, held, dates).groupBy("path", "role").agg(F.count(F.lit(1)).alias("n"))


@query("spl06_walk_forward", with_bars("""n AS MATERIALIZED (SELECT date, count(*) AS c, row_number() OVER (ORDER BY date) - 1 AS k FROM bars GROUP BY date), f AS MATERIALIZED (SELECT year(date) AS y, min(k) AS lo FROM n GROUP BY 1),
g AS (SELECT f.y, year(n.date) = f.y AS test, CAST(sum(c) AS BIGINT) AS n FROM n, f WHERE year(n.date) = f.y OR n.k < f.lo - 6 GROUP BY 1, 2) SELECT y AS year, CASE WHEN test THEN 'test' ELSE 'train' END AS role, n FROM g"""))
def _(spark, d):
    b = trade_bars(spark, d).select("symbol", "date")
    return splits.yearly_walk_forward(b, splits.date_blocks(b)).groupBy("year", "role").agg(F.count(F.lit(1)).alias("n"))


@query("spl07_random_halves")
def _(spark, d):
    return splits.random_halves(trade_bars(spark, d))


@query("set02_03_04_sets", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'union_all', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def _(spark, d):
    o = src.table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FO")
    ops = {"union": a.union(b).distinct(), "except": a.subtract(b), "intersect": a.intersect(b), "union_all": a.union(b)}
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, df in ops.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("set05_keep_first", with_bars("""SELECT symbol, date, round(close, 6) AS close FROM (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol, date ORDER BY pri) AS n FROM (SELECT symbol, date, close, 0 AS pri FROM bars WHERE day(date) < 20 UNION ALL SELECT symbol, date, close + 1, 1 FROM bars)) WHERE n = 1"""))
def _(spark, d):
    b = trade_bars(spark, d).select("symbol", "date", "close")
    both = b.where(F.dayofmonth("date") < 20).withColumn("pri", F.lit(0)).unionByName(b.select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit(1).alias("pri")))
    return rounded(both.withColumn("n", F.row_number().over(Window.partitionBy("symbol", "date").orderBy("pri"))).where("n = 1"), ["symbol", "date", "close"])


_PIVOTED = [f"NATION_{i}" for i in range(25)]


@query("set06_pivot", with_bars("SELECT date, " + ", ".join(f"round(max(close) FILTER (WHERE symbol = '{x}'), 6) AS {x.lower()}" for x in _PIVOTED) + " FROM bars GROUP BY date"))
def _(spark, d):
    p = trade_bars(spark, d).groupBy("date").pivot("symbol", _PIVOTED).agg(F.max("close"))
    return p.select("date", *[F.round(x, 6).alias(x.lower()) for x in _PIVOTED])


@query("srt01_05_last_candles", with_bars("SELECT symbol, date, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars) WHERE n <= 20"))
def _(spark, d):
    return rounded(trade_bars(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("n <= 20"), ["symbol", "date", "close"])


@query("srt02_04_top", with_bars("SELECT symbol, count(*) AS n FROM bars GROUP BY symbol ORDER BY n DESC, symbol LIMIT 12"))
def _(spark, d):
    return trade_bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(12)


@query("srt03_top_share", with_bars("SELECT symbol, date FROM (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS k, count(*) OVER (PARTITION BY date) AS n FROM bars) WHERE k <= greatest(round_even(n * 0.2, 0), 3)"))
def _(spark, d):
    day = Window.partitionBy("date")
    b = trade_bars(spark, d).withColumn("k", F.row_number().over(day.orderBy(F.desc("close"), "symbol"))).withColumn("n", F.count(F.lit(1)).over(day))
    return b.where(F.col("k") <= F.greatest(F.bround(F.col("n") * 0.2), F.lit(3))).select("symbol", "date")


@query("srt06_stratified_pick")
def _(spark, d):
    rows = labels.triple_barrier(trade_bars(spark, d)).where("dropped_reason is null")
    order = Window.partitionBy("symbol", "label").orderBy(F.xxhash64("symbol", "date", F.lit(7)))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").orderBy(F.xxhash64("symbol", "label", F.lit(7))).limit(20).select("symbol", "label", "date")
