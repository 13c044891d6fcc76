"""Backtests. Decisions at a close are filled at the next tradeable open; costs are charged at the exit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import nonzero
from ..sources.bars import tradeable


def backtest(df: DataFrame, signal: str = "signal", cost: float | Column = 0.0035, keys: tuple[str, ...] = ("symbol",), force_close: bool = True) -> DataFrame:
    """``df`` with position, gross_ret, net_ret, gross_equity, net_equity, entry, exit: long or cash, one series for each key.

    The position is the last decision before the bar, held over bars that cannot be traded. A day of entry earns
    close / open, a day held earns close / last mark (an unpriced bar earns 0 and keeps the mark), a day of exit
    open / last mark; the cost comes off at the exit, or at the last bar where the position is closed by force.
    """
    cost = F.lit(cost) if isinstance(cost, float) else cost
    s = Window.partitionBy(*keys).orderBy("date")
    past = s.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("tl_t", tradeable()).withColumn("tl_w", F.coalesce(F.lag(signal).over(s), F.lit(0)))
    df = df.withColumn("position", F.coalesce(F.last(F.when(F.col("tl_t"), F.col("tl_w")), ignorenulls=True).over(past), F.lit(0)).cast("int"))
    df = df.withColumn("tl_p", F.coalesce(F.lag("position").over(s), F.lit(0)))
    df = df.withColumn("tl_m", F.last(F.when(F.col("position") == 1, F.col("close")), ignorenulls=True).over(past))
    df = df.withColumn("tl_b", F.lag("tl_m").over(s)).withColumn("tl_last", F.lead("date").over(s).isNull())
    enter, leave = (F.col("position") == 1) & (F.col("tl_p") == 0), (F.col("position") == 0) & (F.col("tl_p") == 1)
    gross = F.when(enter, F.col("close") / F.col("open") - 1).when(F.col("position") == 1, F.coalesce(F.col("close") / F.col("tl_b") - 1, F.lit(0.0))).when(leave, F.col("open") / F.col("tl_b") - 1).otherwise(0.0)
    forced = (F.col("tl_last") & (F.col("position") == 1)) if force_close else F.lit(False)
    df = df.withColumn("entry", enter).withColumn("exit", leave | forced).withColumn("gross_ret", gross)
    df = df.withColumn("net_ret", F.when(F.col("exit"), (1 + F.col("gross_ret")) * (1 - cost) - 1).otherwise(F.col("gross_ret")))
    df = df.withColumn("gross_equity", F.product(1 + F.col("gross_ret")).over(past)).withColumn("net_equity", F.product(1 + F.col("net_ret")).over(past))
    return df.drop("tl_t", "tl_w", "tl_p", "tl_m", "tl_b")


def trades(run: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row for each trip of a backtest: entry and exit date and price, bars held, gross return, forced."""
    s = Window.partitionBy(*keys).orderBy("date")
    n = F.sum(F.col("entry").cast("int")).over(s.rowsBetween(Window.unboundedPreceding, 0))
    rows = run.withColumn("trade", n).where((F.col("position") == 1) | F.col("exit"))
    forced = F.col("exit") & (F.col("position") == 1)
    price = F.when(forced, F.col("close")).otherwise(F.col("open"))
    return rows.groupBy(*keys, "trade").agg(
        F.min("date").alias("entry_date"), F.min_by("open", "date").alias("entry_price"), F.max(F.when(F.col("exit"), F.col("date"))).alias("exit_date"),
        F.max(F.when(F.col("exit"), price)).alias("exit_price"), F.sum("position").alias("bars_held"), (F.product(1 + F.col("gross_ret")) - 1).alias("gross_return"), F.max(forced).alias("forced"),
    )


def metrics(run: DataFrame, ret: str = "net_ret", keys: tuple[str, ...] = ("symbol",), days: float = 252.0, position: str | None = "position") -> DataFrame:
    """total, cagr (by calendar), vol, sharpe, max_dd, n, exposure of each series of returns."""
    s = Window.partitionBy(*keys).orderBy("date")
    past = s.rowsBetween(Window.unboundedPreceding, 0)
    df = run.withColumn("tl_q", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(past))
    df = df.withColumn("tl_d", F.col("tl_q") / F.greatest(F.max("tl_q").over(past), F.lit(1.0)) - 1)
    total = F.max_by("tl_q", "date")
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    vol = F.stddev_samp(ret) * days**0.5
    cagr = F.when((years > 0) & (total > 0), F.pow(total, 1 / F.when(years > 0, years)) - 1)
    out = [(total - 1).alias("total"), cagr.alias("cagr"), vol.alias("vol"), (F.avg(ret) * days / nonzero(vol)).alias("sharpe"), F.min("tl_d").alias("max_dd"), F.count(ret).alias("n")]
    if position:
        out.append(F.avg(position).alias("exposure"))
    return df.groupBy(*keys).agg(*out)


def buy_and_hold(df: DataFrame, cost: float = 0.0035) -> DataFrame:
    return backtest(df.withColumn("signal", F.lit(1)), "signal", cost)


def equal_weight(run: DataFrame, ret: str = "net_ret", keys: tuple[str, ...] = ()) -> DataFrame:
    """date, ret: the mean over symbols that have a return on the date."""
    return run.groupBy(*keys, "date").agg(F.avg(ret).alias("ret"), F.count(ret).alias("names"))


def fractional(df: DataFrame, weight: str, cost: float = 0.0035) -> DataFrame:
    """date, gross, net, turnover, exposure of weights set at closes: the weight of the day before earns the day's return; half the cost for each unit traded."""
    s = Window.partitionBy("symbol").orderBy("date")
    r = F.col("close") / nonzero(F.lag("close").over(s)) - 1
    held = F.coalesce(F.lag(weight).over(s), F.lit(0.0))
    df = df.withColumn("tl_r", F.coalesce(r, F.lit(0.0))).withColumn("tl_h", held).withColumn("tl_t", F.abs(F.coalesce(F.col(weight), F.lit(0.0)) - held))
    out = df.groupBy("date").agg(F.sum(F.col("tl_h") * F.col("tl_r")).alias("gross"), (F.sum("tl_t")).alias("turnover"), F.sum("tl_h").alias("exposure"))
    return out.withColumn("net", F.col("gross") - F.col("turnover") * cost / 2)


def portfolio_weights(df: DataFrame, signal: str | None = "signal", kind: str = "equal", vol_days: int = 60) -> DataFrame:
    """``weight``: equal among all names, or by inverse volatility renormalised over the date, times the signal."""
    s = Window.partitionBy("symbol").orderBy("date")
    day = Window.partitionBy("date")
    if kind == "equal":
        base = 1 / F.count("close").over(day)
    else:
        df = df.withColumn("tl_r", F.col("close") / nonzero(F.lag("close").over(s)) - 1)
        sd = F.when(F.count("tl_r").over(s.rowsBetween(-(vol_days - 1), 0)) >= vol_days // 2, F.stddev_samp("tl_r").over(s.rowsBetween(-(vol_days - 1), 0)))
        df = df.withColumn("tl_iv", 1 / nonzero(sd))
        base = F.col("tl_iv") / F.sum("tl_iv").over(day)
    return df.withColumn("weight", F.coalesce(base, F.lit(0.0)) * (F.col(signal) if signal else 1.0)).drop("tl_r", "tl_iv")


def vol_target(daily: DataFrame, target: float = 0.15, days: int = 20, causal: bool = True) -> DataFrame:
    """``scale`` for the next day of a return series (date, gross, exposure): target over realised volatility, capped so that exposure does not pass 1.

    ``causal`` caps by the exposure known so far; otherwise by the greatest of the whole sample, as the faithful variant does.
    The series has one row a date.
    """
    s = Window.partitionBy(F.lit(0)).orderBy("date")
    frame = s.rowsBetween(-days, -1)
    vol = F.when(F.count("gross").over(frame) >= days, F.stddev_samp("gross").over(frame) * 252**0.5)
    most = F.max("exposure").over(s.rowsBetween(Window.unboundedPreceding, 0) if causal else s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return daily.withColumn("scale", F.least(F.coalesce(target / nonzero(vol), F.lit(1.0)), 1 / nonzero(most)))


def regime_gate(index: DataFrame, days: int = 200) -> DataFrame:
    """date, open_gate: 1 where the index (date, level) is over its mean of ``days``. One row a date."""
    s = Window.partitionBy(F.lit(0)).orderBy("date")
    frame = s.rowsBetween(-(days - 1), 0)
    mean = F.when(F.count("level").over(frame) >= days, F.avg("level").over(frame))
    return index.select("date", F.coalesce(F.col("level") > mean, F.lit(False)).cast("int").alias("open_gate"))


def rebalanced(df: DataFrame, score: str, every: int = 4, offset: int = 0, share: float = 0.2, least: int = 3, cost: float = 0.00175, lag: int = 1) -> DataFrame:
    """date, formed, strat, bench, turnover: every few dates the names with the best scores, held with drifting weights from the next close on.

    The benchmark holds all scored names. ``cost`` is charged on what the first day of a hold trades.
    """
    day = Window.orderBy("date")
    # dates are few: their numbering is one small sort, the panel is never in one task
    dates = df.select("date").distinct().withColumn("i", F.row_number().over(day) - 1)
    hold = dates.withColumn("k", F.floor((F.col("i") - offset - lag) / every)).where(F.col("i") >= offset + lag)
    formed = dates.select(F.col("date").alias("formed"), F.col("i").alias("fi")).where(f"fi >= {offset} and (fi - {offset}) % {every} = 0").withColumn("k", F.floor((F.col("fi") - offset) / every)).select("formed", "k")
    n = F.count(F.col(score)).over(Window.partitionBy("date"))
    order = F.row_number().over(Window.partitionBy("date").orderBy(F.col(score).desc_nulls_last(), "symbol"))
    ranked = df.where(F.col(score).isNotNull()).withColumn("tl_n", n).withColumn("tl_o", order)
    top = F.greatest(F.bround(F.col("tl_n") * share), F.lit(least))
    picked = ranked.select("symbol", F.col("date").alias("formed"), F.when(F.col("tl_o") <= top, 1 / F.least(top, F.col("tl_n"))).otherwise(0.0).alias("w"), (1 / F.col("tl_n")).alias("bw")).join(formed, "formed")
    s = Window.partitionBy("symbol").orderBy("date")
    rets = df.select("symbol", "date", F.coalesce(F.col("close") / nonzero(F.lag("close").over(s)) - 1, F.lit(0.0)).alias("r")).join(hold, "date")
    rows = picked.join(rets, ["symbol", "k"])
    run = Window.partitionBy("symbol", "k").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.product(1 + F.col("r")).over(run), F.lit(1.0))
    rows = rows.withColumn("dw", F.col("w") * grown).withColumn("db", F.col("bw") * grown)
    daily = rows.groupBy("k", "formed", "date", "i").agg((F.sum(F.col("dw") * F.col("r")) / nonzero(F.sum("dw"))).alias("strat"), (F.sum(F.col("db") * F.col("r")) / nonzero(F.sum("db"))).alias("bench"))
    ended = rows.groupBy("k", "symbol").agg(F.product(1 + F.col("r")).alias("g"), F.max("w").alias("w")).withColumn("e", F.col("w") * F.col("g"))
    ended = ended.withColumn("e", F.col("e") / nonzero(F.sum("e").over(Window.partitionBy("k")))).select("symbol", (F.col("k") + 1).alias("k"), "e")
    traded = picked.select("symbol", "k", "w").join(ended, ["symbol", "k"], "full").groupBy("k").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("e", F.lit(0.0)))).alias("traded"))
    first = F.row_number().over(Window.partitionBy("k").orderBy("date")) == 1
    out = daily.withColumn("first", first).join(traded, "k", "left")
    return out.select("date", "formed", (F.col("strat") - F.when(F.col("first"), F.col("traded") * cost).otherwise(0.0)).alias("strat"), "bench", F.when(F.col("first"), F.col("traded") / 2).otherwise(0.0).alias("turnover"))


def rank_portfolio(df: DataFrame, score: str, lag: int = 0, cost: float = 0.0) -> DataFrame:
    """date, gross, net, turnover: weights in proportion to the date's rank of the score (``lag`` rows old) earn the next day's return.

    ``date`` is the day on which the weights are held; what is traded is against the weights of the day before as returns moved them.
    """
    s, day = Window.partitionBy("symbol").orderBy("date"), Window.partitionBy("date")
    rank = F.when(F.col(score).isNotNull(), F.rank().over(day.orderBy(F.col(score).asc_nulls_last())) + (F.count(score).over(Window.partitionBy("date", score)) - 1) / 2)
    df = df.withColumn("tl_k", rank).withColumn("tl_k", F.col("tl_k") / nonzero(F.sum("tl_k").over(day)))
    df = df.withColumn("tl_w", F.coalesce(F.lag("tl_k", lag).over(s) if lag else F.col("tl_k"), F.lit(0.0)))
    df = df.withColumn("tl_r", F.coalesce(F.lead("close").over(s) / nonzero(F.col("close")) - 1, F.lit(0.0)))
    df = df.withColumn("tl_d", F.col("tl_w") * (1 + F.col("tl_r"))).withColumn("tl_d", F.coalesce(F.col("tl_d") / nonzero(F.sum("tl_d").over(day)), F.lit(0.0)))
    df = df.withColumn("tl_t", F.abs(F.col("tl_w") - F.coalesce(F.lag("tl_d").over(s), F.lit(0.0))))
    daily = df.groupBy("date").agg(F.sum(F.col("tl_w") * F.col("tl_r")).alias("gross"), F.sum("tl_t").alias("turnover"))
    return daily.withColumn("net", (1 - F.col("turnover") * cost) * (1 + F.col("gross")) - 1)


def period_backtest(samples: DataFrame, score: str, ret: str, share: float = 0.2, least: int = 3, cost: float = 0.00175) -> DataFrame:
    """step, segment, strat, bench, traded of samples (step, symbol, ...): the best share of each step earns its period's return.

    Steps without a gap are a segment; weights drift within it, and its last step pays for the way out.
    """
    steps = samples.select("step").distinct()
    seg = steps.withColumn("segment", F.col("step") - F.row_number().over(Window.orderBy("step")))  # steps are few
    day = Window.partitionBy("step")
    rows = samples.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    rows = rows.withColumn("o", F.row_number().over(day.orderBy(F.col(score).desc(), "symbol"))).withColumn("n", F.count(F.lit(1)).over(day))
    top = F.greatest(F.bround(F.col("n") * share), F.lit(least))
    rows = rows.select("step", "symbol", F.col(ret).alias("r"), F.when(F.col("o") <= top, 1 / F.least(top, F.col("n"))).otherwise(0.0).alias("w"), (1 / F.col("n")).alias("b")).join(seg, "step")
    grown = F.col("w") * (1 + F.col("r"))
    rows = rows.withColumn("e", grown / nonzero(F.sum(grown).over(day)))
    ended = rows.select("segment", "symbol", (F.col("step") + 1).alias("step"), "e").join(seg.select("segment", "step"), ["segment", "step"])
    moved = rows.select("segment", "step", "symbol", "w").join(ended, ["segment", "step", "symbol"], "full").groupBy("step").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("e", F.lit(0.0)))).alias("traded"))
    out = rows.groupBy("segment", "step").agg(F.sum(F.col("w") * F.col("r")).alias("gross"), F.sum(F.col("b") * F.col("r")).alias("bench")).join(moved, "step")
    last = F.col("step") == F.max("step").over(Window.partitionBy("segment"))
    out = out.withColumn("traded", F.col("traded") + F.when(last, 1.0).otherwise(0.0))
    return out.select("step", "segment", ((1 + F.col("gross")) * (1 - F.col("traded") * cost) - 1).alias("strat"), "bench", "traded")


def benchmark_bundle(df: DataFrame, index: DataFrame, cost: float = 0.0035) -> DataFrame:
    """name and metrics of the equal-weight hold of all symbols and of the index (date, level)."""
    hold = equal_weight(buy_and_hold(df, cost)).select(F.lit("equal_weight_hold").alias("name"), "date", "ret")
    level = index.select(F.lit("index").alias("name"), "date", (F.col("level") / nonzero(F.lag("level").over(Window.partitionBy(F.lit(0)).orderBy("date"))) - 1).alias("ret"))  # a row a date
    return metrics(hold.unionByName(level), "ret", ("name",), position=None)


def close_to_close(df: DataFrame, position: str) -> DataFrame:
    """symbol, n_active, hit_rate, mean_ret, sharpe, total: the position at a close earns the next close's return, without costs, over active rows."""
    s = Window.partitionBy("symbol").orderBy("date")
    df = df.withColumn("tl_r", F.col(position) * (F.lead("close").over(s) / nonzero(F.col("close")) - 1))
    active = F.when((F.col(position) != 0) & F.col("tl_r").isNotNull(), F.col("tl_r"))
    df = df.withColumn("tl_a", active)
    return df.groupBy("symbol").agg(
        F.count("tl_a").alias("n_active"), F.avg(F.when(F.col("tl_a").isNotNull(), (F.col("tl_a") > 0).cast("double"))).alias("hit_rate"), F.avg("tl_a").alias("mean_ret"),
        (F.avg("tl_a") / nonzero(F.stddev_samp("tl_a")) * 252**0.5).alias("sharpe"), (F.product(1 + F.coalesce("tl_a", F.lit(0.0))) - 1).alias("total"),
    )


def smoothed(df: DataFrame, score: str, out: str, limit: int = 5, mean: int = 10) -> DataFrame:
    """Forecasts carried on for at most ``limit`` rows, then the mean of ``mean``; rows of dates on which a name lacks one are NULL."""
    s = Window.partitionBy("symbol").orderBy("date")
    df = df.withColumn("tl_f", F.last(F.col(score), ignorenulls=True).over(s.rowsBetween(-limit, 0)))
    frame = s.rowsBetween(-(mean - 1), 0)
    df = df.withColumn("tl_a", F.when(F.count("tl_f").over(frame) == mean, F.avg("tl_f").over(frame)))
    day = Window.partitionBy("date")
    return df.withColumn(out, F.when(F.count("tl_a").over(day) == F.count(F.lit(1)).over(day), F.col("tl_a"))).drop("tl_f", "tl_a")
