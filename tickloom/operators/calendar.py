"""Trading calendar, alignment, universe, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import nonzero, run_id, series
from .adjust import STRUCTURAL, usable
from .ranges import within


def trading_calendar(bars: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """date, session_no (from 0): the union of dates, less special sessions (date). Dates are few; their numbering is one small sort."""
    dates = bars.select("date").where("date is not null").distinct()
    if special is not None:
        dates = dates.join(special.select("date").distinct(), "date", "left_anti")
    return dates.withColumn("session_no", F.row_number().over(Window.orderBy("date")) - 1)


def sessions_by_share(bars: DataFrame, share: float = 0.5) -> DataFrame:
    """date: days on which more than ``share`` of the listed symbols (those with a bar) traded."""
    return bars.groupBy("date").agg((F.sum((F.col("volume") > 0).cast("int")) / F.count("volume")).alias("s")).where(F.col("s") > share).select("date")


def calendar_report(calendar: DataFrame, special: DataFrame | None = None, most_gap: int = 6) -> DataFrame:
    """One row: sessions, duplicates, weekend days that are no special sessions, gaps of more than ``most_gap`` days, the longest."""
    s = Window.orderBy("date")
    days = calendar.select("date").withColumn("gap", F.datediff("date", F.lag("date").over(s))).withColumn("weekend", F.weekday("date") >= 5)
    if special is not None:
        days = days.join(special.select("date").distinct().withColumn("sp", F.lit(1)), "date", "left").withColumn("weekend", F.col("weekend") & F.col("sp").isNull())
    return days.agg(
        F.count(F.lit(1)).alias("sessions"), (F.count("date") - F.countDistinct("date")).alias("duplicates"), F.sum(F.col("weekend").cast("long")).alias("weekends"),
        F.sum((F.col("gap") > most_gap).cast("long")).alias("long_gaps"), F.max("gap").alias("longest_gap"),
    )


def aligned(bars: DataFrame, calendar: DataFrame, delisted: DataFrame | None = None) -> DataFrame:
    """Each symbol on every session from its first bar on: no_data marks sessions in its life without a close, post_delisting those after ``last_bar``."""
    life = bars.groupBy("symbol").agg(F.min("date").alias("first_bar"), F.max("date").alias("last_bar"))
    if delisted is not None:
        life = life.join(delisted.select("symbol", F.col("last_bar").alias("cut")), "symbol", "left").withColumn("last_bar", F.coalesce("cut", "last_bar")).drop("cut")
    grid = life.join(calendar.select("date"), F.col("date") >= F.col("first_bar"))
    df = grid.join(bars, ["symbol", "date"], "left")
    after = F.col("date") > F.col("last_bar")
    return df.withColumn("no_data", F.col("close").isNull() & ~after).withColumn("post_delisting", after).withColumn("pre_listing", F.lit(False)).drop("first_bar", "last_bar")


def off_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars on dates that are no sessions."""
    return bars.join(calendar.select("date"), "date", "left_anti")


def flagged(df: DataFrame, dates: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with a flag on the dates, the dates that it lacks)."""
    wanted = dates.select("date").distinct()
    return df.join(wanted.withColumn("tl_f", F.lit(1)), "date", "left").withColumn(name, F.coalesce("tl_f", F.lit(0))).drop("tl_f"), wanted.join(df.select("date").distinct(), "date", "left_anti")


def index_audit(index: DataFrame, calendar: DataFrame) -> DataFrame:
    """For each index: rows, duplicates, missing closes, weekend days, sessions without a row."""
    span = index.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.count("date") - F.countDistinct("date")).alias("duplicates"), F.sum(F.col("close").isNull().cast("long")).alias("missing_closes"), F.sum((F.weekday("date") >= 5).cast("long")).alias("weekends"))
    met = index.select("symbol", "date").distinct().join(calendar.select("date").distinct(), "date").groupBy("symbol").agg(F.count(F.lit(1)).alias("tl_met"))
    total = calendar.agg(F.countDistinct("date").alias("tl_total"))  # one row
    out = span.join(met, "symbol", "left").crossJoin(F.broadcast(total))
    return out.withColumn("missing_sessions", F.col("tl_total") - F.coalesce("tl_met", F.lit(0))).drop("tl_met", "tl_total")


def identical_runs(bars: DataFrame, most: int = 3) -> DataFrame:
    """Runs of more than ``most`` - 1 equal bars: symbol, start, stop, n."""
    same = reduce(lambda a, c: a & (F.col(c) == F.lag(c).over(series())), ("open", "high", "low", "close"), F.lit(True))
    df = bars.withColumn("tl_s", same).withColumn("tl_r", run_id(F.col("tl_s")))
    return df.groupBy("symbol", "tl_r").agg(F.min("date").alias("start"), F.max("date").alias("stop"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).drop("tl_r")


def stale_or_bad(bars: DataFrame) -> DataFrame:
    """Bars without a repeat of the bar before and with positive prices."""
    same = reduce(lambda a, c: a & (F.col(c) == F.lag(c).over(series())), ("open", "high", "low", "close"), F.coalesce(F.col("volume"), F.lit(0.0)) == 0)
    return bars.withColumn("tl_s", F.coalesce(same, F.lit(False))).where("not tl_s and open > 0 and high > 0 and low > 0 and close > 0").drop("tl_s")


def blanked(bars: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Every value NULL on rows that did not trade."""
    bad = F.coalesce(F.col("volume"), F.lit(0.0)) <= 0
    return bars.select(*[F.when(~bad, F.col(c)).alias(c) if c in columns else F.col(c) for c in bars.columns])


def eligible(bars: DataFrame, least: int = 273) -> DataFrame:
    """``eligible``: at least that many closes so far, and one today."""
    n = F.count("close").over(series().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("eligible", (n >= least) & F.col("close").isNotNull())


def jump_guarded(bars: DataFrame, ahead: int = 20, most: float = 0.20) -> DataFrame:
    """Rows whose next bars hold no move of more than ``most``."""
    df = bars.withColumn("tl_r", F.abs(F.col("close") / nonzero(F.lag("close").over(series())) - 1))
    return df.withColumn("tl_m", F.max("tl_r").over(series().rowsBetween(1, ahead))).where(f"coalesce(tl_m, 0) <= {most}").drop("tl_r", "tl_m")


def purge_windows(actions: DataFrame, horizon: int = 10) -> DataFrame:
    """symbol, start, stop: from ceil(1.6 * horizon) + 2 calendar days before a structural ex-date to it."""
    days = -(-16 * horizon // 10) + 2
    return actions.where(F.col("action_type").isin(*STRUCTURAL)).select("symbol", F.date_sub("ex_date", days).alias("start"), F.col("ex_date").alias("stop")).distinct()


def embargo_windows(boundaries: DataFrame, calendar: DataFrame, horizon: int = 10) -> DataFrame:
    """boundary, start, stop: ``horizon`` sessions to both sides, or twice as many days where the boundary is no session."""
    at = boundaries.join(calendar, boundaries.boundary == calendar.date, "left").select("boundary", "session_no")
    low = calendar.select(F.col("session_no").alias("n0"), F.col("date").alias("d0"))
    high = calendar.select(F.col("session_no").alias("n1"), F.col("date").alias("d1"))
    df = at.join(low, F.col("n0") == F.col("session_no") - horizon, "left").join(high, F.col("n1") == F.col("session_no") + horizon, "left")
    return df.select("boundary", F.coalesce("d0", F.date_sub("boundary", 2 * horizon)).alias("start"), F.coalesce("d1", F.date_add("boundary", 2 * horizon)).alias("stop"))


def session_offset(df: DataFrame, calendar: DataFrame, date: str, h: int, out: str) -> DataFrame:
    """``out``: the session ``h`` after the date's, at most the last one; NULL where the date is no session."""
    last = calendar.agg(F.max("session_no").alias("tl_last"))
    here = calendar.select(F.col("date").alias("tl_d"), F.col("session_no").alias("tl_n"))
    there = calendar.select(F.col("date").alias(out), F.col("session_no").alias("tl_t"))
    df = df.join(here, F.col(date) == F.col("tl_d"), "left").crossJoin(F.broadcast(last))  # one row
    return df.withColumn("tl_w", F.least(F.col("tl_n") + h, F.col("tl_last"))).join(there, F.col("tl_w") == F.col("tl_t"), "left").drop("tl_d", "tl_n", "tl_last", "tl_w", "tl_t")


def universe(bars: DataFrame, actions: DataFrame, calendar: DataFrame, holdout: str, warmup: int = 210, horizon: int = 10, children: tuple[str, ...] = (), unexplained: DataFrame | None = None) -> DataFrame:
    """symbol, first_bar, last_bar, total_sessions, pre_holdout_sessions, eligible_from, truncate_at, n_samples, exclude_reason (the first that holds; fixed values).

    Sessions count from the calendar. ``children``: symbols that a demerger made. ``unexplained``: symbols with moves that no action explains.
    """
    cut_day = F.lit(holdout).cast("date")
    life = bars.groupBy("symbol").agg(F.min("date").alias("first_bar"), F.max("date").alias("last_bar"))
    life = life.join(calendar.select("date", "session_no"), F.col("date").between(F.col("first_bar"), F.col("last_bar"))).groupBy("symbol", "first_bar", "last_bar").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.sum((F.col("date") < cut_day).cast("long")).alias("pre_holdout_sessions"), (F.min("session_no") + warmup + horizon).alias("tl_n")
    )
    life = life.join(calendar.select(F.col("session_no").alias("tl_s"), F.col("date").alias("eligible_from")), F.col("tl_n") == F.col("tl_s"), "left").drop("tl_n", "tl_s")
    cut = actions.where((F.col("action_type") == "demerger") & (F.col("ratio").isNull() | F.coalesce(F.col("confidence") == "UNVERIFIED", F.lit(False)))).groupBy("symbol").agg(F.min("ex_date").alias("truncate_at"))
    odd = unexplained.select("symbol", F.lit(True).alias("tl_odd")).distinct() if unexplained is not None else actions.select("symbol", F.lit(True).alias("tl_odd")).limit(0)
    df = life.join(cut, "symbol", "left").join(odd, "symbol", "left").withColumn("n_samples", F.greatest(F.col("total_sessions") - warmup - horizon, F.lit(0)))
    child = F.col("symbol").isin(*children) if children else F.lit(False)
    reason = F.when(child, "demerger_child_overlaps_parent").when(F.col("first_bar") >= cut_day, "holdout_only_listing").when(F.col("pre_holdout_sessions") < warmup + horizon, "insufficient_history").when(F.col("tl_odd"), "unadjusted_big_move")
    return df.withColumn("exclude_reason", reason).drop("tl_odd")


def members(panel: DataFrame, as_of: str) -> DataFrame:
    """symbol of a membership panel (date, symbol, in_universe) on a date; an error where the panel does not have the date."""
    rows = panel.where(F.col("date") == F.lit(as_of).cast("date"))
    if rows.isEmpty():
        raise KeyError(f"no membership for {as_of}")
    return rows.where("in_universe").select("symbol").distinct()


def turnover_universe(bars: DataFrame, days: int = 126, top: int = 10, least: int = 60) -> DataFrame:
    """``turnover_rank`` of the median traded value, 1 the largest, and ``in_universe``."""
    df = bars.withColumn("tl_v", F.col("close") * F.col("volume"))
    frame = series().rowsBetween(-(days - 1), 0)
    df = df.withColumn("tl_m", F.when(F.count("tl_v").over(frame) >= least, F.percentile("tl_v", F.lit(0.5)).over(frame)))
    rank = F.when(F.col("tl_m").isNotNull(), F.rank().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("tl_m"))))
    return df.withColumn("turnover_rank", rank).withColumn("in_universe", F.coalesce(F.col("turnover_rank") <= top, F.lit(False))).drop("tl_v", "tl_m")


def violations(bars: DataFrame, calendar: DataFrame, eps: float = 1e-6) -> DataFrame:
    """symbol, date, rule: one row for each rule that a bar breaks."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    listed = calendar.select("date", F.lit(1).alias("tl_in"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("symbol", "date")) > 1
    df = bars.join(listed, "date", "left").withColumn("tl_t", twice)
    rules = F.array(
        F.when(h + eps < F.greatest(o, c), "high_below_body"), F.when(low - eps > F.least(o, c), "low_above_body"), F.when(h + eps < low, "high_below_low"),
        F.when((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), "price_not_positive"), F.when(F.col("tl_t"), "duplicate_date"), F.when(F.col("tl_in").isNull(), "not_a_session"),
    )
    rows = df.select("symbol", "date", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    return rows.unionByName(identical_runs(bars).select("symbol", F.col("start").alias("date"), F.lit("identical_run").alias("rule")))


def uncovered_moves(bars: DataFrame, actions: DataFrame, threshold: float = 0.15, days: int = 3) -> DataFrame:
    """symbol, date, move: moves of at least the threshold without an action within so many calendar days: a band join by buckets of days."""
    moves = bars.withColumn("move", F.col("close") / nonzero(F.lag("close").over(series())) - 1).where(F.abs("move") >= threshold).select("symbol", "date", "move")
    near = actions.select("symbol", F.date_sub("ex_date", days).alias("tl_from"), F.date_add("ex_date", days).alias("tl_to")).distinct()
    return within(moves, near, ["symbol"], "date", "tl_from", "tl_to", 2 * days + 2, "left_anti")


def validation(bars: DataFrame, calendar: DataFrame, actions: DataFrame) -> DataFrame:
    """For each symbol: passed, problems, uncaught moves."""
    bad = violations(bars, calendar).groupBy("symbol").agg(F.count(F.lit(1)).alias("problems"))
    moves = uncovered_moves(bars, actions).groupBy("symbol").agg(F.count(F.lit(1)).alias("uncaught"))
    df = bars.select("symbol").distinct().join(bad, "symbol", "left").join(moves, "symbol", "left").na.fill(0, ["problems", "uncaught"])
    return df.withColumn("passed", F.col("problems") == 0)


def complete(bars: DataFrame, least: int) -> DataFrame:
    """One row: symbols, complete."""
    return bars.agg(F.countDistinct("symbol").alias("symbols")).withColumn("complete", F.col("symbols") >= least)


def label_check(labelled: DataFrame, bars: DataFrame, horizon: int = 10) -> DataFrame:
    """symbol, date, problem of labels that their bars do not bear out: a touched bar that does not reach its barrier, a Sideways window that does."""
    at = bars.select("symbol", "date", F.row_number().over(series()).alias("i"), "high", "low")
    rows = labelled.where("dropped_reason is null").join(at.select("symbol", "date", "i"), ["symbol", "date"])
    later = at.select("symbol", F.col("i").alias("j"), F.col("date").alias("d"), "high", "low")
    met = within(later, rows.withColumns({"tl_from": F.col("i") + 1, "tl_to": F.col("i") + horizon}), ["symbol"], "j", "tl_from", "tl_to", 4 * horizon)
    hit = (F.col("high") >= F.col("upper_barrier")) | (F.col("low") <= F.col("lower_barrier"))
    g = met.groupBy("symbol", "date", "label", "touch_date").agg(F.max((hit & (F.col("d") == F.col("touch_date"))).cast("int")).alias("touched"), F.max(hit.cast("int")).alias("any"))
    problem = F.when((F.col("label") == "Sideways") & (F.col("any") == 1), "sideways_touches").when((F.col("label") != "Sideways") & (F.coalesce("touched", F.lit(0)) == 0), "touch_not_there")
    return g.withColumn("problem", problem).where("problem is not null").select("symbol", "date", "problem")
