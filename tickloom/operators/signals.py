"""Rules that give a 0/1 signal a bar, decided at its close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import change, extreme_before, series, so_far, zscore
from ..functions.scans import machine
from . import indicators as ind

def hysteresis(enter: Column, leave: Column, known: Column) -> Column:
    """In after ``enter``, out after ``leave``, out where the input is missing: the last event decides.

    Only for rules whose enter and leave exclude each other; a rule where both can hold toggles, see ``toggles``.
    """
    event = F.when(~known, 0).when(F.coalesce(enter, F.lit(False)), 1).when(F.coalesce(leave, F.lit(False)), 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(so_far()), F.lit(0))


def toggles(df: DataFrame, enter: str, leave: str, out: str, known: str | None = None) -> DataFrame:
    """A machine whose enter and leave can hold on one bar: out of the market only enter counts, in it only leave.

    Each bar is one of four maps of the state: out where the input is missing or only leave holds, in where only enter does, the other state
    where both do, and no change.
    """
    there = F.lit(True) if known is None else F.coalesce(F.col(known), F.lit(False))
    e, x = (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in (enter, leave))
    return machine(df, e & ~x, ~there | (x & ~e), e & x, out)


def flag(rule: Column) -> Column:
    """1 where the rule holds, 0 where it does not or something is missing."""
    return F.coalesce(rule, F.lit(False)).cast("int")


def simple_rules(df: DataFrame) -> DataFrame:
    """sig_hold, sig_mom252, sig_macd, sig_ema_cross, sig_ema_adx, sig_obv, sig_ad, sig_vwpm."""
    df = ind.macd(df, prefix="s_m")
    df = ind.adx(ind.ema(ind.ema(df, 20, "s_e20"), 50, "s_e50"))
    df = ind.volume_weighted_move(ind.accumulation(ind.obv(df)), 20, "s_w")
    c = F.col
    return df.withColumns(
        {
            "sig_hold": F.lit(1), "sig_mom252": flag(change(F.col("close"), 252) > 0), "sig_macd": flag(c("s_m_line") > c("s_m_signal")), "sig_ema_cross": flag(c("s_e20") > c("s_e50")),
            "sig_ema_adx": flag((c("s_e20") > c("s_e50")) & (c("adx") > 25)), "sig_obv": flag(c("obv") > c("obv_ema")), "sig_ad": flag(F.round("ad", 6) > F.round(F.lag("ad", 20).over(series()), 6)), "sig_vwpm": flag(c("s_w") > 0),
        }
    ).drop("s_m_line", "s_m_signal", "s_m_hist", "s_e20", "s_e50", "s_w")


def oscillator_rules(df: DataFrame) -> DataFrame:
    """Hysteresis on oscillators: RSI 30/50, 30/70, 60/40, stochastic 20/50, CCI -100/0, %R -80/-50."""
    df = ind.stochastic(ind.cci(ind.williams_r(ind.rsi(df, 14, "s_rsi", "seeded"))))
    rules = {"rsi_30_50": ("s_rsi", 30, 50), "rsi_30_70": ("s_rsi", 30, 70), "stoch_20_50": ("stoch_k", 20, 50), "cci_100_0": ("cci", -100, 0), "willr_80_50": ("willr", -80, -50)}
    out = {f"sig_{k}": hysteresis(F.col(c) < a, F.col(c) > b, F.col(c).isNotNull()) for k, (c, a, b) in rules.items()}
    out["sig_rsi_60_40"] = hysteresis(F.col("s_rsi") > 60, F.col("s_rsi") < 40, F.col("s_rsi").isNotNull())
    return df.withColumns(out).drop("s_rsi")


def band_rules(df: DataFrame) -> DataFrame:
    """sig_bb: in under the lower Bollinger band, out over the middle; sig_kc: in over the upper Keltner band, out under its middle."""
    df = ind.keltner(ind.bollinger(df))
    c = F.col("close")
    return df.withColumns(
        {"sig_bb": hysteresis(c < F.col("bb_low"), c > F.col("bb_mid"), F.col("bb_mid").isNotNull()), "sig_kc": hysteresis(c > F.col("kc_up"), c < F.col("kc_mid"), F.col("kc_up").isNotNull())}
    )


def rsi_rules(df: DataFrame) -> DataFrame:
    """RSI rules with gates: over 50, from 40 on, 60/40 with means, means alone, velocity, z-score."""
    df = ind.ema(ind.ema(ind.rsi(df, 14, "s_r", "seeded"), 20, "s_e20"), 50, "s_e50")
    r = F.col("s_r")
    base = hysteresis(r > 60, r < 40, r.isNotNull())
    over20, over50 = F.coalesce(F.col("close") > F.col("s_e20"), F.lit(False)), F.coalesce(F.col("s_e20") > F.col("s_e50"), F.lit(False))
    return df.withColumn("tl_b", base).withColumns(
        {
            "sig_rsi50": flag(r > 50), "sig_rsi40": flag(r >= 40), "sig_rsi_ema20": (F.col("tl_b") == 1).cast("int") * over20.cast("int"), "sig_rsi_ema50": (F.col("tl_b") == 1).cast("int") * (over20 & over50).cast("int"),
            "sig_ema20": over20.cast("int"), "sig_velocity": flag((r - F.lag(r, 5).over(series()) > 0) & (r > 50)), "sig_rsi_z": flag(zscore(r, 60) > 0),
        }
    ).drop("s_r", "s_e20", "s_e50", "tl_b")


def divergence_rule(df: DataFrame, out: str = "sig_div") -> DataFrame:
    """In on a close under the ten before it while RSI stays over its own least of ten, out over 60. Both can hold: a machine that toggles."""
    df = ind.rsi(df, 14, "s_r", "seeded")
    r, c = F.col("s_r"), F.col("close")
    enter = (c < extreme_before(F.min, c, 10)) & (r > extreme_before(F.min, r, 10))
    df = df.withColumn("s_in", F.coalesce(enter, F.lit(False))).withColumn("s_out", F.coalesce(r > 60, F.lit(False))).withColumn("s_there", r.isNotNull())
    return toggles(df, "s_in", "s_out", out, "s_there").drop("s_r", "s_in", "s_out", "s_there")


def double_tops(df: DataFrame, x: str, window: int = 25, tol: float = 1.0, upper: float = 60.0, lower: float = 40.0) -> DataFrame:
    """m_top, w_bottom on each bar at which one holds.

    A turning point is no less (no more) than both neighbours, so it is known a bar later; points up to two bars ago and
    within ``window`` bars count. W: the last two lows under ``lower``, the second not more than ``tol`` under the first,
    and x now over the highest high between them. M is its mirror image over ``upper``.
    """
    v = F.col(x)
    before, after = F.lag(x, 1).over(series()), F.lead(x, 1).over(series())
    df = df.withColumn("tl_n", F.row_number().over(series()))
    point = F.struct(F.col("tl_n").alias("n"), v.alias("v"))
    df = df.withColumn("tl_hi", F.when((v >= before) & (v >= after), point)).withColumn("tl_lo", F.when((v <= before) & (v <= after), point))
    frame = series().rowsBetween(-window, -2)
    df = df.withColumn("tl_his", F.collect_list("tl_hi").over(frame)).withColumn("tl_los", F.collect_list("tl_lo").over(frame))

    def crossed(ends: str, others: str, sign: int, level: float) -> Column:
        a, b = (F.try_element_at(F.col(ends), F.lit(-k)) for k in (2, 1))
        between = F.transform(F.filter(others, lambda p: (p["n"] > a["n"]) & (p["n"] < b["n"])), lambda p: sign * p["v"])
        rule = (sign * a["v"] < sign * level) & (sign * b["v"] < sign * level) & (sign * b["v"] >= sign * a["v"] - tol) & (sign * v > F.array_max(between))
        return F.coalesce(rule & (F.col("tl_n") > window + 2), F.lit(False))

    return df.withColumn("m_top", crossed("tl_his", "tl_los", -1, upper)).withColumn("w_bottom", crossed("tl_los", "tl_his", 1, lower)).drop("tl_n", "tl_hi", "tl_lo", "tl_his", "tl_los")


def configurable_rule(df: DataFrame, entry: float = 60.0, floor: float | None = 40.0, ceiling: float | None = None, entry_on_w: bool = False, exit_on_m: bool = False, above_ema: int | None = None, out: str = "sig_conf") -> DataFrame:
    """In when RSI is over ``entry`` (or on a W), gated by a mean; out under ``floor`` (breakdown), over ``ceiling`` (overbought; both: bracket), or on an M."""
    df = double_tops(ind.rsi(df, 14, "s_r", "seeded"), "s_r")
    r = F.col("s_r")
    enter = (r > entry) | (F.col("w_bottom") if entry_on_w else F.lit(False))
    if above_ema:
        df = ind.ema(df, above_ema, "s_e")
        enter = enter & (F.col("close") > F.col("s_e"))
    leave = F.lit(False) if floor is None else r < floor
    if ceiling is not None:
        leave = leave | (r > ceiling)
    if exit_on_m:
        leave = leave | F.col("m_top")
    df = df.withColumn("s_in", F.coalesce(enter, F.lit(False))).withColumn("s_out", F.coalesce(leave, F.lit(False))).withColumn("s_there", r.isNotNull())
    return toggles(df, "s_in", "s_out", out, "s_there").drop("s_r", "s_in", "s_out", "s_there", "s_e", "m_top", "w_bottom")


def grid_rule(df: DataFrame, params: DataFrame) -> DataFrame:
    """Bars for each row of ``params`` (rule, entry, exit_floor, n_rsi, n_ema, confirm): in over entry and, with ``confirm``, over the mean; out under the floor.

    The grid's indicator periods are few: each is one column, and the parameters choose among them.
    """
    spans = params.select("n_rsi", "n_ema").distinct().collect()  # the grid is written by hand
    for n in sorted({r["n_rsi"] for r in spans}):
        df = ind.rsi(df, n, f"s_r{n}", "seeded")
    for n in sorted({r["n_ema"] for r in spans}):
        df = ind.ema(df, n, f"s_e{n}")
    pick = lambda p, c: F.coalesce(*[F.when(F.col(c) == n, F.col(f"{p}{n}")) for n in sorted({r[c] for r in spans})])
    each = df.crossJoin(F.broadcast(params)).withColumn("s_r", pick("s_r", "n_rsi")).withColumn("s_e", pick("s_e", "n_ema"))
    spec = Window.partitionBy("symbol", "rule").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col("s_r").isNull(), 0).when((F.col("s_r") > F.col("entry")) & (~F.col("confirm") | (F.col("close") > F.col("s_e"))), 1).when(F.col("s_r") < F.col("exit_floor"), 0)
    return each.withColumn("signal", F.coalesce(F.last(event, ignorenulls=True).over(spec), F.lit(0)))


def score_positions(score: Column, threshold: float = 0.1, allow_short: bool = False) -> Column:
    """1 over the threshold, -1 (or 0) under its negative, 0 between and where the score is missing."""
    return F.when(score > threshold, 1).when(score < -threshold, -1 if allow_short else 0).otherwise(0)


def rule_label(*, rsi: Column, ema: Column, entry: Column, floor: Column) -> Column:
    """A text for a combination of parameters."""
    return F.format_string("RSI%d>%.0f/<%.0f EMA%d", rsi, entry, floor, ema)
