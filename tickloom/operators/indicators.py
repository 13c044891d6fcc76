"""Technical indicators over bars (symbol, date, open, high, low, close, volume): each adds columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ewm import ewm
from ..functions.lineage import kept
from ..functions.orderstats import Rolling, rolling_order
from ..functions.rolling import change, extreme_before, filled, nonzero, past, rolling, section_zscore, series, so_far, true_range, zscore
from ..functions.scans import affine

def _rsi_of(up: str, down: str) -> Column:
    return F.when(F.col(down) > 0, 100 - 100 / (1 + F.col(up) / F.col(down))).when(F.col(up) > 0, 100.0)


def rsi(df: DataFrame, n: int = 14, out: str = "rsi", mode: str = "recursive") -> DataFrame:
    """Wilder's RSI. ``recursive``: means begin with the first change and count from n of them on; ``seeded``: with the mean of the first n.

    Gains without losses give 100; neither gives NULL.
    """
    d = F.col("close") - F.lag("close").over(series())
    df = df.withColumn("tl_d", d)
    for name, x in (("tl_up", F.greatest(F.col("tl_d"), F.lit(0.0))), ("tl_dn", F.greatest(-F.col("tl_d"), F.lit(0.0)))):
        df = ewm(df, F.when(F.col("tl_d").isNotNull(), x), name, 1 / n, mode, seed=n, least=n)
    return df.withColumn(out, _rsi_of("tl_up", "tl_dn")).drop("tl_d", "tl_up", "tl_dn")


def ema(df: DataFrame, n: int, out: str, mode: str = "seeded", x: Column | None = None, least: int | None = None) -> DataFrame:
    return ewm(df, F.col("close") if x is None else x, out, 2 / (n + 1), mode, seed=n, least=least or (n if mode == "seeded" else 1))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, mode: str = "recursive", prefix: str = "macd") -> DataFrame:
    """<prefix>_line, <prefix>_signal, <prefix>_hist. The line counts from ``slow`` bars on, the signal from ``signal`` lines more."""
    for n, name in ((fast, "tl_f"), (slow, "tl_sl")):
        df = ewm(df, F.col("close"), name, 2 / (n + 1), mode, least=n)
    df = df.withColumn(f"{prefix}_line", F.col("tl_f") - F.col("tl_sl")).drop("tl_f", "tl_sl")
    df = ewm(df, F.col(f"{prefix}_line"), f"{prefix}_signal", 2 / (signal + 1), mode, least=signal)
    return df.withColumn(f"{prefix}_hist", F.col(f"{prefix}_line") - F.col(f"{prefix}_signal"))


def stochastic(df: DataFrame, n: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    """stoch_k, stoch_d: simple means of where the close is in the range of n bars."""
    low, high = rolling(F.min, F.col("low"), n), rolling(F.max, F.col("high"), n)
    df = df.withColumn("tl_k", F.when(high > low, 100 * (F.col("close") - low) / (high - low)))
    df = df.withColumn("stoch_k", rolling(F.avg, F.col("tl_k"), k))
    return df.withColumn("stoch_d", rolling(F.avg, F.col("stoch_k"), d)).drop("tl_k")


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Distance of the typical price from its mean, over 0.015 of its mean absolute deviation."""
    df = df.withColumn("tl_t", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("tl_m", rolling(F.avg, F.col("tl_t"), n)).withColumn("tl_w", F.collect_list("tl_t").over(past(n)))
    deviation = F.aggregate("tl_w", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("tl_m"))) / n
    return df.withColumn("cci", F.when(deviation > 0, (F.col("tl_t") - F.col("tl_m")) / (0.015 * deviation))).drop("tl_t", "tl_m", "tl_w")


def williams_r(df: DataFrame, n: int = 14) -> DataFrame:
    low, high = rolling(F.min, F.col("low"), n), rolling(F.max, F.col("high"), n)
    return df.withColumn("willr", F.when(high > low, -100 * (high - F.col("close")) / (high - low)))


def atr_mean(df: DataFrame, n: int = 14, out: str = "atr_mean") -> DataFrame:
    """The plain mean of n true ranges (labels)."""
    return df.withColumn("tl_tr", true_range()).withColumn(out, rolling(F.avg, F.col("tl_tr"), n)).drop("tl_tr")


def atr_seeded(df: DataFrame, n: int = 14, out: str = "atr_seeded") -> DataFrame:
    """Wilder's, from the mean of the first n ranges that have a close before them (features)."""
    df = df.withColumn("tl_tr", F.when(F.lag("close").over(series()).isNotNull(), true_range()))
    return ewm(df, F.col("tl_tr"), out, 1 / n, "seeded", seed=n).drop("tl_tr")


def atr_wilder(df: DataFrame, n: int = 14, out: str = "atr_wilder") -> DataFrame:
    """Wilder's without warm-up, nulls passed over (patterns)."""
    return ewm(df.withColumn("tl_tr", true_range()), F.col("tl_tr"), out, 1 / n).drop("tl_tr")


def wilder(df: DataFrame, x: Column, n: int, out: str) -> DataFrame:
    """The smoother itself: no warm-up, nulls ignored."""
    return ewm(df, x, out, 1 / n)


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """plus_di, minus_di, adx: sums of directional moves and true ranges by Wilder, from n-1 moves on; adx starts with the mean of n."""
    up, down = F.col("high") - F.lag("high").over(series()), F.lag("low").over(series()) - F.col("low")
    df = df.withColumn("tl_u", up).withColumn("tl_n", down).withColumn("tl_tr", F.when(F.col("tl_u").isNotNull(), true_range()))
    plus = F.when(F.col("tl_u").isNotNull(), F.when((F.col("tl_u") > F.col("tl_n")) & (F.col("tl_u") > 0), F.col("tl_u")).otherwise(0.0))
    minus = F.when(F.col("tl_u").isNotNull(), F.when((F.col("tl_n") > F.col("tl_u")) & (F.col("tl_n") > 0), F.col("tl_n")).otherwise(0.0))
    df = df.withColumn("tl_p", plus).withColumn("tl_m", minus)
    for c in ("tl_p", "tl_m", "tl_tr"):
        df = ewm(df, F.col(c), f"{c}_s", 1 / n, "seeded", seed=n)
    df = df.withColumn("plus_di", 100 * F.col("tl_p_s") / nonzero(F.col("tl_tr_s"))).withColumn("minus_di", 100 * F.col("tl_m_s") / nonzero(F.col("tl_tr_s")))
    df = df.withColumn("tl_dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / nonzero(F.col("plus_di") + F.col("minus_di")))
    return ewm(df, F.col("tl_dx"), "adx", 1 / n, "seeded", seed=n).drop("tl_u", "tl_n", "tl_tr", "tl_p", "tl_m", "tl_p_s", "tl_m_s", "tl_tr_s", "tl_dx")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """bb_mid, bb_up, bb_low, bb_pct_b, bb_width; the deviation is that of the population."""
    mid, sd = rolling(F.avg, F.col("close"), n), rolling(F.stddev_pop, F.col("close"), n)
    df = df.withColumn("bb_mid", mid).withColumn("bb_up", mid + k * sd).withColumn("bb_low", mid - k * sd)
    gap = nonzero(F.col("bb_up") - F.col("bb_low"))
    return df.withColumn("bb_pct_b", (F.col("close") - F.col("bb_low")) / gap).withColumn("bb_width", gap / nonzero(F.col("bb_mid")))


def keltner(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """kc_mid, kc_up, kc_low: the seeded EMA and k of the seeded ATR(14)."""
    df = atr_seeded(ema(df, n, "kc_mid"), 14, "tl_a")
    return df.withColumn("kc_up", F.col("kc_mid") + k * F.col("tl_a")).withColumn("kc_low", F.col("kc_mid") - k * F.col("tl_a")).drop("tl_a")


def obv(df: DataFrame, n: int = 20) -> DataFrame:
    """obv (starts with the first volume), obv_ema, obv_zero (starts with 0)."""
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(series())), F.lit(0.0)) * F.col("volume")
    first = F.row_number().over(series()) == 1
    df = df.withColumn("tl_s", step).withColumn("tl_f", F.when(first, F.col("volume")).otherwise(F.col("tl_s")))
    df = df.withColumn("obv", F.sum("tl_f").over(so_far())).withColumn("obv_zero", F.sum("tl_s").over(so_far()))
    return ema(df, n, "obv_ema", "recursive", F.col("obv"), least=n).drop("tl_s", "tl_f")


def accumulation(df: DataFrame) -> DataFrame:
    """ad: the running sum of volume times where the close is between low and high."""
    place = F.when(F.col("high") > F.col("low"), (2 * F.col("close") - F.col("low") - F.col("high")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return df.withColumn("tl_m", place * F.col("volume")).withColumn("ad", F.sum("tl_m").over(so_far())).drop("tl_m")


def volume_weighted_move(df: DataFrame, n: int = 20, out: str = "vwpm") -> DataFrame:
    """The sum of return times volume over the sum of volume."""
    df = df.withColumn("tl_r", change(F.col("close")) * F.col("volume"))
    return df.withColumn(out, rolling(F.sum, F.col("tl_r"), n) / nonzero(rolling(F.sum, F.col("volume"), n))).drop("tl_r")


def volume_breadth(df: DataFrame, n: int = 20) -> DataFrame:
    """vol_breadth: the share of the last n bars (fewer at the start) whose volume was above its own mean; a bar without a mean is not above it."""
    df = df.withColumn("tl_a", F.coalesce(F.col("volume") > rolling(F.avg, F.col("volume"), n), F.lit(False)).cast("double"))
    return df.withColumn("vol_breadth", F.avg("tl_a").over(past(n))).drop("tl_a")


def seasonality(df: DataFrame, least_rows: int = 30) -> DataFrame:
    """season: half the mean of all returns so far on the same day of the month, and half that in the same month; 0 on the first rows."""
    df = df.withColumn("tl_r", change(F.col("close")))
    for name, part in (("tl_day", F.dayofmonth("date")), ("tl_month", F.month("date"))):
        df = df.withColumn(name, F.avg("tl_r").over(Window.partitionBy("symbol", part).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    mean = (F.coalesce("tl_day", F.lit(0.0)) + F.coalesce("tl_month", F.lit(0.0))) / 2
    return df.withColumn("season", F.when(F.row_number().over(series()) >= least_rows, mean).otherwise(0.0)).drop("tl_r", "tl_day", "tl_month")


def efficiency(df: DataFrame, n: int = 10) -> DataFrame:
    """er: the move over n bars over the sum of the moves."""
    df = df.withColumn("tl_m", F.abs(F.col("close") - F.lag("close").over(series())))
    return df.withColumn("er", F.abs(F.col("close") - F.lag("close", n).over(series())) / nonzero(rolling(F.sum, F.col("tl_m"), n))).drop("tl_m")


def kama(df: DataFrame, n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """kama, kama_slope (change over one bar): Kaufman's mean, whose smoothing follows the efficiency ratio.

    It starts on bar n with the close, and is NULL for symbols of n bars or fewer. A step is the affine map y + c (close - y).
    """
    df = efficiency(df, n)
    quick, late = 2 / (fast + 1), 2 / (slow + 1)
    c = F.pow(F.coalesce("er", F.lit(0.0)) * (quick - late) + late, F.lit(2))
    df = df.withColumns({"tl_i": F.row_number().over(series()), "tl_rows": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "tl_c": c})
    start = F.when((F.col("tl_i") == n) & (F.col("tl_rows") > n), F.col("close"))
    df = affine(df, 1 - F.col("tl_c"), F.col("tl_c") * F.col("close"), start, "kama").drop("tl_i", "tl_rows", "tl_c")
    return df.withColumn("kama_slope", F.col("kama") - F.lag("kama").over(series()))


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, with 1 for a missing or zero y."""
    return x / F.when(y.isNull() | (y == 0), 1.0).otherwise(y)


def next_candle_score(df: DataFrame, least_rows: int = 30) -> DataFrame:
    """score2, score3: weighted trend, swing and push in -1 .. 1; NULL on the first rows and where a part is missing.

    Trend and push are in units of the ATR (seeded with the mean of the first 14 ranges) and count by the efficiency
    ratio, the swing of RSI(2) by the rest. The weights are fixed values: 0.4, 0.2, 0.2, and 0.35, 0.15, 0.15, 0.10
    (efficiency), 0.10 (volume breadth), 0.15 (season).
    """
    df = ewm(df.withColumn("tl_tr", true_range()), F.col("tl_tr"), "tl_atr", 1 / 14, "seeded", seed=14)
    df = volume_breadth(seasonality(macd(rsi(kama(df), 2, "rsi2"), prefix="tl_macd")))
    er = F.col("er")
    trend, push = safe_ratio(F.col("kama_slope"), F.col("tl_atr")) * er, safe_ratio(F.col("tl_macd_hist"), F.col("tl_atr")) * er
    swing = F.coalesce((F.col("rsi2") - 50) / 50, F.lit(0.0)) * (1 - er)
    enough = F.row_number().over(series()) >= least_rows

    def cut(x: Column) -> Column:
        return F.when(enough & x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))

    two = 0.4 * trend + 0.2 * swing + 0.2 * push
    three = 0.35 * trend + 0.15 * swing + 0.15 * push + 0.10 * er + 0.10 * (2 * F.col("vol_breadth") - 1) + 0.15 * 2 * F.col("season")
    return df.withColumn("score2", cut(two)).withColumn("score3", cut(three)).drop("tl_macd_line", "tl_macd_signal", "tl_macd_hist", "tl_atr", "tl_tr")


def sector_features(df: DataFrame, index: DataFrame | None = None, spans: tuple[int, ...] = (5, 20), z: int = 60) -> DataFrame:
    """rel_market_n, rel_sector_n, rel_market_20_z: an n-day return less that of the index on the symbol's own dates, and less the mean of the sector's other symbols; NULL where no other has one.

    ``index``: date, level; without one the date's mean close.
    """
    level = F.avg("close").over(Window.partitionBy("date"))
    df = df.withColumn("tl_i", level) if index is None else df.join(index.select("date", F.col("level").alias("tl_i")), "date", "left")
    peers = Window.partitionBy("date", "sector")
    for n in spans:
        df = df.withColumn(f"tl_r{n}", change(F.col("close"), n)).withColumn(f"rel_market_{n}", F.col(f"tl_r{n}") - change(F.col("tl_i"), n))
        own = F.coalesce(F.col(f"tl_r{n}"), F.lit(0.0))
        others = (F.sum(f"tl_r{n}").over(peers) - own) / nonzero((F.count(f"tl_r{n}").over(peers) - F.col(f"tl_r{n}").isNotNull().cast("int")).cast("double"))
        df = df.withColumn(f"rel_sector_{n}", F.col(f"tl_r{n}") - others)
    return df.withColumn("rel_market_20_z", zscore(F.col("rel_market_20"), z)).drop("tl_i", *[f"tl_r{n}" for n in spans])


def long_term_features(df: DataFrame) -> DataFrame:
    """ret_252, above_sma200, dist_sma200, golden (1, -1, 0 of the 50-day over the 200-day mean, with a band of 0.1 %)."""
    df = df.withColumn("tl_50", rolling(F.avg, F.col("close"), 50)).withColumn("tl_200", rolling(F.avg, F.col("close"), 200)).withColumn("ret_252", change(F.col("close"), 252))
    gap = F.col("tl_50") / nonzero(F.col("tl_200")) - 1
    df = df.withColumn("above_sma200", F.when(F.col("tl_200").isNotNull(), (F.col("close") > F.col("tl_200")).cast("double"))).withColumn("dist_sma200", F.col("close") / nonzero(F.col("tl_200")) - 1)
    return df.withColumn("golden", F.when(gap > 0.001, 1.0).when(gap < -0.001, -1.0).when(gap.isNotNull(), 0.0)).drop("tl_50", "tl_200")


def rsi_features(df: DataFrame) -> DataFrame:
    """rsi, its differences, z-scores, range share, relative place, divergences and distances from two means."""
    df = ema(ema(rsi(df, 14, "rsi", "seeded"), 20, "tl_e20"), 50, "tl_e50")
    r = F.col("rsi")
    low_c, low_r = extreme_before(F.min, F.col("close"), 10), extreme_before(F.min, r, 10)
    high_c, high_r = extreme_before(F.max, F.col("close"), 10), extreme_before(F.max, r, 10)
    lo, hi = rolling(F.min, r, 10), rolling(F.max, r, 10)
    return df.withColumns(
        {
            "rsi_d1": r - F.lag(r, 1).over(series()), "rsi_d5": r - F.lag(r, 5).over(series()), "rsi_z30": zscore(r, 30), "rsi_z60": zscore(r, 60),
            # 1 while 20 bars stay at 40 or above, -1 while they stay at 60 or below (which decides where both hold)
            "rsi_range": F.when(rolling(F.max, r, 20) <= 60, -1.0).when(rolling(F.min, r, 20) >= 40, 1.0).when(rolling(F.min, r, 20).isNotNull(), 0.0),
            "rsi_above60": (r > 60).cast("double"), "rsi_below40": (r < 40).cast("double"), "rsi_place": (r - lo) / nonzero(hi - lo),
            # comparisons with what is missing are false here, not missing
            "rsi_bull_div": F.coalesce((F.col("close") < low_c) & (r > low_r), F.lit(False)).cast("double"),
            "rsi_bear_div": F.coalesce((F.col("close") > high_c) & (r < high_r), F.lit(False)).cast("double"),
            "dist_ema20": F.col("close") / nonzero(F.col("tl_e20")) - 1, "dist_ema50": F.col("close") / nonzero(F.col("tl_e50")) - 1,
        }
    ).drop("tl_e20", "tl_e50")


def baseline_inputs(df: DataFrame) -> DataFrame:
    """Eight inputs of the baseline models: log return, RSI(14), MACD line, ATR(14), Bollinger width, OBV from 0, SMA(14), volume; and b_y, the next log return."""
    c = F.col("close")
    df = obv(atr_mean(macd(rsi(df, 14, "b_rsi"), prefix="tl_b", mode="weighted"), 14, "b_atr"))
    df = df.withColumn("b_ret", F.log(c) - F.log(F.lag(c).over(series())))
    return df.withColumns(
        {"b_macd": F.col("tl_b_line"), "b_width": 4 * rolling(F.stddev_samp, c, 20) / nonzero(rolling(F.avg, c, 20)), "b_obv": F.col("obv_zero"), "b_sma": rolling(F.avg, c, 14), "b_volume": F.col("volume"), "b_y": F.lead("b_ret").over(series())}
    ).drop("tl_b_line", "tl_b_signal", "tl_b_hist", "obv", "obv_zero", "obv_ema")


def minmax_scaled(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns scaled to 0 .. 1 by the least and greatest values of training rows, for each symbol."""
    group = Window.partitionBy("symbol")
    out = {}
    for c in columns:
        low, high = F.min(F.when(train, F.col(c))).over(group), F.max(F.when(train, F.col(c))).over(group)
        out[c] = (F.col(c) - low) / nonzero(high - low)
    return df.withColumns(out)


def windows_of(df: DataFrame, columns: list[str], n: int = 60) -> DataFrame:
    """``window``: the last n rows of the columns as an array of arrays; NULL where fewer, or one with a NULL in it, are there."""
    whole = F.when(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0, F.array(*columns))
    return df.withColumn("tl_w", whole).withColumn("window", F.when(F.count("tl_w").over(past(n)) == n, F.collect_list("tl_w").over(past(n)))).drop("tl_w")


def _voted(df: DataFrame) -> DataFrame:
    """``df`` with votes, the columns that only they need (v_) and those of the indicators. Kept twice on the way: in one piece the plan is over 200 operators deep, too deep for Spark's event log and a small driver."""
    df = kept(ema(ema(rsi(stochastic(cci(williams_r(df))), 14, "v_r", "seeded"), 20, "v_e20"), 50, "v_e50"))
    df = kept(adx(macd(df, prefix="v_m")))
    df = accumulation(obv(keltner(bollinger(atr_seeded(df, 14, "v_a")))))
    df = rolling_order(volume_weighted_move(df, 20, "v_w"), {"v_rank": Rolling("rank", F.col("v_a") / nonzero(F.col("close")), 252, 60)}).withColumn("v_ad", F.round("ad", 6) - F.round(F.lag("ad", 20).over(series()), 6))

    def vote(up: Column, down: Column | None = None) -> Column:
        out = F.when(up, 1)
        return (out if down is None else out.when(down, -1)).otherwise(0)

    c = F.col
    return df.withColumns(
        {
            "vote_rsi": vote(c("v_r") < 30, c("v_r") > 70), "vote_stoch": vote(c("stoch_k") < 20, c("stoch_k") > 80), "vote_cci": vote(c("cci") < -100, c("cci") > 100), "vote_willr": vote(c("willr") < -80, c("willr") > -20),
            "vote_ema": vote(c("v_e20") > c("v_e50"), c("v_e20") < c("v_e50")), "vote_adx": vote(c("adx") > 25), "vote_macd": vote(c("v_m_line") > c("v_m_signal"), c("v_m_line") < c("v_m_signal")),
            "vote_bb": vote(F.col("close") < c("bb_low"), F.col("close") > c("bb_up")), "vote_kc": vote(F.col("close") > c("kc_up"), F.col("close") < c("kc_low")), "vote_vol": vote(c("v_rank") > 0.75),
            "vote_obv": vote(c("obv") > c("obv_ema"), c("obv") < c("obv_ema")), "vote_ad": vote(c("v_ad") > 0, c("v_ad") < 0), "vote_vwpm": vote(c("v_w") > 0, c("v_w") < 0),
        }
    )


def votes(df: DataFrame) -> DataFrame:
    """Thirteen votes (1, -1 or 0) of four families. What is missing votes 0. Needs no column but bars'. Running sums that agree in six digits are a tie."""
    return _voted(df).drop("v_r", "v_e20", "v_e50", "v_m_line", "v_m_signal", "v_m_hist", "v_a", "v_w", "v_rank", "v_ad")


VOTES = ("rsi", "stoch", "cci", "willr", "ema", "adx", "macd", "bb", "kc", "vol", "obv", "ad", "vwpm")


def index_momentum(section: DataFrame, long: str, short: str, sigma: str) -> DataFrame:
    """``idx_mom``: the mean of the z-scores, within a date, of two returns over volatility; NULLs take the date's median."""
    df = section
    for k, r in enumerate((long, short)):
        df = df.withColumn(f"tl_z{k}", F.col(r) / nonzero(F.col(sigma)))
        df = df.withColumn(f"tl_z{k}", section_zscore(F.col(f"tl_z{k}")))
    df = df.withColumn("tl_m", (F.col("tl_z0") + F.col("tl_z1")) / 2)
    return df.withColumn("idx_mom", F.coalesce("tl_m", F.percentile("tl_m", F.lit(0.5)).over(Window.partitionBy("date")))).drop("tl_z0", "tl_z1", "tl_m")


def feature_table(df: DataFrame) -> DataFrame:
    """The frozen table: symbol, date, 22 continuous features and 13 votes."""
    same = {"v_r": "rsi14", "v_e20": "ema20", "v_e50": "ema50", "v_m_line": "macd_line", "v_m_signal": "macd_signal", "v_a": "atr14", "v_w": "vwpm20"}
    out = _voted(df).withColumnsRenamed(same).withColumn("atr_pct", F.col("atr14") / nonzero(F.col("close")))
    return out.select("symbol", "date", *CONTINUOUS, *[f"vote_{v}" for v in VOTES])


CONTINUOUS = (
    "rsi14", "stoch_k", "stoch_d", "cci", "willr", "ema20", "ema50", "adx", "macd_line", "macd_signal", "atr14", "atr_pct",
    "bb_up", "bb_mid", "bb_low", "kc_up", "kc_mid", "kc_low", "obv", "obv_ema", "ad", "vwpm20",
)
