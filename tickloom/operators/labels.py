"""Labels: what happened after a bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import nonzero, section_median, section_rank, series
from .indicators import atr_mean
from .ranges import within


def triple_barrier(df: DataFrame, up: float = 2.0, down: float = 1.0, horizon: int = 10, n_atr: int = 14, purge: DataFrame | None = None, truncate: DataFrame | None = None) -> DataFrame:
    """symbol, date, label (Up, Down, Sideways), touch_date, atr, upper_barrier, lower_barrier, dropped_reason.

    The first of the next ``horizon`` bars to touch a barrier decides; a bar that touches both is Down. ``purge`` has
    (symbol, start, stop) of windows to leave out, ``truncate`` (symbol, truncate_at). Reasons to drop go in this order:
    after the cut, in a purge window, ATR not warm, too few bars ahead, a window that crosses the cut.
    """
    df = atr_mean(df, n_atr, "atr")
    bar = F.struct(F.col("date").alias("date"), F.col("high").alias("h"), F.col("low").alias("l"))
    ahead = series().rowsBetween(1, horizon)
    df = df.withColumn("tl_a", F.collect_list(bar).over(ahead))
    df = df.withColumn("upper_barrier", F.col("close") + up * F.col("atr")).withColumn("lower_barrier", F.col("close") - down * F.col("atr"))
    df = df.join(truncate, "symbol", "left") if truncate is not None else df.withColumn("truncate_at", F.lit(None).cast("date"))
    if purge is not None:
        inside = within(df.select("symbol", "date"), purge.select("symbol", "start", "stop"), ["symbol"], "date", "start", "stop", 32, "left_semi")
        hit = inside.select(F.col("symbol").alias("hs"), F.col("date").alias("hd")).distinct()
        df = df.join(hit, (F.col("symbol") == F.col("hs")) & (F.col("date") == F.col("hd")), "left").withColumn("tl_p", F.col("hs").isNotNull()).drop("hs", "hd")
    else:
        df = df.withColumn("tl_p", F.lit(False))
    touched = F.get(F.filter("tl_a", lambda b: (b["h"] >= F.col("upper_barrier")) | (b["l"] <= F.col("lower_barrier"))), F.lit(0))
    df = df.withColumn("tl_t", touched)
    stop = F.element_at("tl_a", -1)["date"]
    reason = (
        F.when(F.col("date") >= F.col("truncate_at"), "post_truncate").when(F.col("tl_p"), "purge_window").when(F.col("atr").isNull() | F.col("close").isNull(), "insufficient_atr_warmup")
        .when(F.size("tl_a") < horizon, "insufficient_forward_window").when(stop >= F.col("truncate_at"), "crosses_truncate")
    )
    label = F.when(F.col("tl_t").isNull(), "Sideways").when(F.col("tl_t.l") <= F.col("lower_barrier"), "Down").otherwise("Up")
    df = df.withColumn("dropped_reason", reason)
    ok = F.col("dropped_reason").isNull()
    return df.select("symbol", "date", F.when(ok, label).alias("label"), F.when(ok, F.col("tl_t.date")).alias("touch_date"), "atr", "upper_barrier", "lower_barrier", "dropped_reason")


def panel_barrier(df: DataFrame, up: float = 2.0, down: float = 1.0, horizon: int = 10, atr: str = "atr") -> DataFrame:
    """``lab``: 1, -1 or 0 with entry at the next open, barriers around it; NULL without the bar ``horizon`` days on."""
    entry = F.lead("open").over(series())
    ahead = series().rowsBetween(1, horizon)
    df = df.withColumn("tl_e", entry).withColumn("tl_a", F.collect_list(F.struct(F.col("high").alias("h"), F.col("low").alias("l"))).over(ahead)).withColumn("tl_c", F.lead("close", horizon).over(series()))
    high, low = F.col("tl_e") + up * F.col(atr), F.col("tl_e") - down * F.col(atr)
    df = df.withColumn("tl_u", high).withColumn("tl_d", low)
    hit = F.get(F.filter("tl_a", lambda b: (b["h"] >= F.col("tl_u")) | (b["l"] <= F.col("tl_d"))), F.lit(0))
    df = df.withColumn("tl_h", hit)
    lab = F.when(F.col("tl_c").isNull() | F.col("tl_e").isNull() | F.col(atr).isNull(), None).when(F.col("tl_h").isNull(), 0).when(F.col("tl_h.l") <= F.col("tl_d"), -1).otherwise(1)
    return df.withColumn("lab", lab).drop("tl_e", "tl_a", "tl_c", "tl_u", "tl_d", "tl_h")


def outcomes(df: DataFrame, direction: int = 1, k: float = 1.0, horizon: int = 20, atr: str = "atr") -> DataFrame:
    """out_win, out_day, out_ret: target and stop k ATR from the next open; later bars that open beyond a level fill at the open."""
    bar = F.struct(*[F.col(c).alias(c[0]) for c in ("open", "high", "low", "close")])
    df = df.withColumn("tl_e", F.lead("open").over(series())).withColumn("tl_a", F.collect_list(bar).over(series().rowsBetween(1, horizon)))
    df = df.withColumn("tl_g", F.col("tl_e") + direction * k * F.col(atr)).withColumn("tl_s", F.col("tl_e") - direction * k * F.col(atr))
    good, bad = ("h", "l") if direction > 0 else ("l", "h")
    reach = lambda x, level: x >= level if direction > 0 else x <= level
    fall = lambda x, level: x <= level if direction > 0 else x >= level
    g, s = F.col("tl_g"), F.col("tl_s")
    worse = lambda o: F.least(o, s) if direction > 0 else F.greatest(o, s)

    def at(b, i):
        opened = i > 0
        # a later bar that opens beyond the target wins at its open; otherwise the stop goes first
        return F.when(opened & reach(b["o"], g), F.struct((i + 1).alias("day"), F.lit(1).alias("win"), b["o"].alias("p"))).when(fall(b[bad], s), F.struct((i + 1).alias("day"), F.lit(0).alias("win"), F.when(opened, worse(b["o"])).otherwise(s).alias("p"))).when(reach(b[good], g), F.struct((i + 1).alias("day"), F.lit(1).alias("win"), g.alias("p")))

    first = F.get(F.filter(F.transform("tl_a", at), lambda x: x.isNotNull()), F.lit(0))
    df = df.withColumn("tl_f", F.when(F.col("tl_e").isNotNull() & F.col(atr).isNotNull(), first)).withColumn("tl_n", F.size("tl_a"))
    ended = F.element_at("tl_a", -1)["c"]
    ret = F.when(F.col("tl_f").isNotNull(), direction * (F.col("tl_f.p") / F.col("tl_e") - 1)).when((F.col("tl_n") == horizon) & F.col(atr).isNotNull(), direction * (ended / F.col("tl_e") - 1))
    return df.withColumn("out_win", F.col("tl_f.win")).withColumn("out_day", F.col("tl_f.day")).withColumn("out_ret", ret).drop("tl_e", "tl_a", "tl_g", "tl_s", "tl_f", "tl_n")


def measured_moves(events: DataFrame, bars: DataFrame, horizon: int = 60) -> DataFrame:
    """``events`` (symbol, pattern, date, dir, stop, target) with result, exit_day, ret: filled at the next open, at most ``horizon`` bars on.

    Events meet bars by symbol and bucket of places in the series, so an event is compared with the bars near it only; a minimum picks the first touch.
    """
    s = Window.partitionBy("symbol").orderBy("date")
    placed = bars.select("symbol", "date", "open", "high", "low", "close", F.row_number().over(s).alias("i"))
    of = events.join(placed.select("symbol", "date", F.col("i").alias("t")), ["symbol", "date"])
    later = placed.select("symbol", "i", "open", "high", "low", "close")
    rows = within(later, of.withColumns({"tl_from": F.col("t") + 1, "tl_to": F.col("t") + horizon}), ["symbol"], "i", "tl_from", "tl_to", horizon)
    up = F.col("dir") > 0
    beyond = (F.col("i") > F.col("t") + 1) & F.when(up, F.col("open") >= F.col("target")).otherwise(F.col("open") <= F.col("target"))
    stopped = F.when(up, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    won = F.when(up, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    worse = F.when(up, F.least("open", "stop")).otherwise(F.greatest("open", "stop"))
    hit = F.when(beyond, F.struct("i", F.lit("target").alias("r"), F.col("open").alias("p"))).when(stopped, F.struct("i", F.lit("stop").alias("r"), worse.alias("p"))).when(won, F.struct("i", F.lit("target").alias("r"), F.col("target").alias("p")))
    keys = [*events.columns, "t"]
    out = rows.withColumn("hit", hit).groupBy(*keys).agg(F.min("hit").alias("hit"), F.min_by("open", "i").alias("entry"), F.max_by("close", "i").alias("last"), F.max("i").alias("end"))
    price = F.coalesce(F.col("hit.p"), F.col("last"))
    result = F.coalesce(F.col("hit.r"), F.when(F.col("end") - F.col("t") == horizon, "timeout").otherwise("open"))
    return out.select(*events.columns, "entry", result.alias("result"), (F.coalesce(F.col("hit.i"), F.col("end")) - F.col("t")).alias("exit_day"), (F.col("dir") * (price / nonzero(F.col("entry")) - 1)).alias("ret"))


def forward_return(df: DataFrame, hold: int = 21, delay: int = 1) -> DataFrame:
    """fwd_ret from ``delay`` days on for ``hold`` days, fwd_excess over the date's mean, y_rank (-0.5 .. 0.5), y_up (over the date's median)."""
    r = F.lead("close", delay + hold).over(series()) / nonzero(F.lead("close", delay).over(series()) if delay else F.col("close")) - 1
    df = df.withColumn("fwd_ret", r)
    x = F.col("fwd_ret")
    return df.withColumn("fwd_excess", x - F.avg(x).over(Window.partitionBy("date"))).withColumn("y_rank", section_rank(x) - 0.5).withColumn("y_up", F.when(x.isNotNull(), (x > section_median(x)).cast("int")))
