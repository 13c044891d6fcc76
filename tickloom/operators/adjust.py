"""Corporate actions: which ones prices already carry, adjusted bars, dividends, quality flags.

``bars``: symbol, date, open .. close, volume (adj_close where there is one). ``actions``: symbol, ex_date,
action_type, ratio, dividend_amount, source, confidence. Actions are a small table beside bars, but nothing here relies on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import nonzero, product_after, series, so_far

STRUCTURAL = ("split", "bonus", "demerger", "rights")
VOLUME_KINDS = ("split", "bonus")


def usable(ratio: Column) -> Column:
    """A finite ratio of at least 1."""
    return F.coalesce(ratio.isNotNull() & ~F.isnan(ratio) & (ratio >= 1) & (ratio < float("inf")), F.lit(False))


def uncrossable(actions: DataFrame) -> DataFrame:
    """Structural actions without a usable ratio: no price may be compared across them."""
    return actions.where(F.col("action_type").isin(*STRUCTURAL) & ~usable(F.col("ratio")))


def approximate(actions: DataFrame) -> DataFrame:
    return actions.where(F.coalesce(F.col("confidence"), F.lit("")).contains("RATIO_APPROX"))


def derived_dates(actions: DataFrame) -> DataFrame:
    return actions.where(F.coalesce(F.col("confidence"), F.lit("")).contains("DERIVED"))


def volume_unhandled(actions: DataFrame) -> DataFrame:
    """Structural actions that change prices but have no rule for volume."""
    return actions.where(F.col("action_type").isin("rights", "demerger") & usable(F.col("ratio")))


def pending(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions after a symbol's last bar."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_bar"))
    return actions.join(last, "symbol").where("ex_date > last_bar").drop("last_bar")


def anchored(bars: DataFrame, events: DataFrame, on: str = "ex_date") -> DataFrame:
    """``events`` with ``anchor``, the symbol's first bar on or after the event; NULL past its last bar.

    An as-of join forward: bars and events lie in one series by date, and an event looks for the next bar. One
    shuffle by symbol; no event meets more than its own row.
    """
    b = bars.select("symbol", F.col("date").alias("tl_d"), F.lit(1).alias("tl_k"), F.lit(None).cast("string").alias("tl_e"))
    e = events.withColumn("tl_e", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}))
    keyed = e.select("symbol", F.col(on).alias("tl_d"), F.lit(0).alias("tl_k"), "tl_e").distinct()
    # backwards in time the next bar is the last one seen: a running frame, in linear time
    s = Window.partitionBy("symbol").orderBy(F.desc("tl_d"), F.desc("tl_k")).rowsBetween(Window.unboundedPreceding, 0)
    found = b.unionByName(keyed).withColumn("anchor", F.last(F.when(F.col("tl_k") == 1, F.col("tl_d")), ignorenulls=True).over(s)).where("tl_k = 0")
    return e.join(found.select("symbol", "tl_e", "anchor"), ["symbol", "tl_e"]).select(*events.columns, "anchor")


def as_of_backward(left: DataFrame, right: DataFrame, value: str, limit_days: int | None = None) -> DataFrame:
    """``left`` (symbol, date) with the last ``value`` of ``right`` on or before the date, not older than ``limit_days``."""
    r = right.select("symbol", "date", F.struct(F.col("date").alias("d"), F.col(value).alias("v")).alias("tl_v"), F.lit(0).alias("tl_k")).where(F.col("tl_v.v").isNotNull())
    both = left.withColumn("tl_k", F.lit(1)).unionByName(r, allowMissingColumns=True)
    s = Window.partitionBy("symbol").orderBy("date", "tl_k").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("tl_l", F.last("tl_v", ignorenulls=True).over(s)).where("tl_k = 1")
    fresh = F.lit(True) if limit_days is None else F.datediff("date", F.col("tl_l.d")) <= limit_days
    return out.withColumn(value, F.when(fresh, F.col("tl_l.v"))).select(*left.columns, value)


def folded(bars: DataFrame, actions: DataFrame, tol: float = 0.10, margin: float = 0.25) -> DataFrame:
    """symbol, ex_date, r_all, r_split, observed, verdict, closest: whether prices around an ex-date carry its ratios already.

    Candidates: not folded (all ratios), splits folded (the others), all folded (1). Candidates that lie within ``margin``
    of each other cannot be told apart; else one within ``tol`` of the observed step is the verdict, and otherwise
    the case is ambiguous and the closest candidate counts.
    """
    use = actions.where(F.col("action_type").isin(*STRUCTURAL) & usable(F.col("ratio")))
    per = use.groupBy("symbol", "ex_date").agg(F.product("ratio").alias("r_all"), F.product(F.when(F.col("action_type") == "split", F.col("ratio"))).alias("r_split"))
    at = anchored(bars, per)
    prices = bars.select("symbol", F.col("date").alias("anchor"), (F.lag("close").over(series()) / nonzero(F.col("close"))).alias("observed"))
    df = at.join(prices, ["symbol", "anchor"], "left")
    rest = F.col("r_all") / F.col("r_split")
    near_one = F.least(F.abs(F.col("r_all") - 1), F.coalesce(F.abs(rest - 1), F.lit(9.0))) < 1e-9
    kinds = F.filter(
        F.array(F.struct(F.lit("NOT_FOLDED").alias("k"), F.col("r_all").alias("v")), F.when(F.col("r_split").isNotNull(), F.struct(F.lit("PREFOLDED").alias("k"), rest.alias("v"))), F.when(~near_one, F.struct(F.lit("FULLY_PREFOLDED").alias("k"), F.lit(1.0).alias("v")))),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("tl_c", kinds)
    values = F.transform("tl_c", lambda x: x["v"])
    spread = (F.array_max(values) - F.array_min(values)) / F.array_min(values)
    hits = F.filter("tl_c", lambda x: F.abs(F.col("observed") / x["v"] - 1) <= tol)
    near = F.element_at(F.array_sort(F.transform("tl_c", lambda x: F.struct(F.abs(F.log(F.col("observed")) - F.log(x["v"])).alias("e"), x["k"].alias("k")))), 1)["k"]
    there = F.col("observed").isNotNull() & (F.col("observed") > 0)
    verdict = F.when(~there, "INSUFFICIENT_DATA").when(spread < margin, "NOT_DISTINGUISHABLE").when(F.size(hits) == 1, F.get(hits, F.lit(0))["k"]).otherwise("AMBIGUOUS")
    return df.withColumn("verdict", verdict).withColumn("closest", F.when(there, near)).drop("tl_c")


def applied(bars: DataFrame, actions: DataFrame, policy: str = "auto", tol: float = 0.10, margin: float = 0.25) -> DataFrame:
    """The structural actions that adjust prices, with their anchors. ``always``: all; ``never``: all but splits; ``auto``: what the verdicts leave."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("tl_last"))
    use = actions.where(F.col("action_type").isin(*STRUCTURAL) & usable(F.col("ratio"))).join(last, "symbol").where("ex_date <= tl_last").drop("tl_last")
    if policy == "never":
        use = use.where("action_type <> 'split'")
    elif policy == "auto":
        v = folded(bars, actions, tol, margin).select("symbol", "ex_date", F.when(F.col("verdict") == "AMBIGUOUS", F.col("closest")).otherwise(F.col("verdict")).alias("tl_v"))
        use = use.join(v, ["symbol", "ex_date"], "left").where("tl_v = 'NOT_FOLDED' or (tl_v = 'PREFOLDED' and action_type <> 'split')").drop("tl_v")
    elif policy != "always":
        raise ValueError(f"unknown policy {policy!r}")
    return anchored(bars, use)


def with_divisors(bars: DataFrame, actions: DataFrame, policy: str = "auto", volume_policy: str | None = None) -> DataFrame:
    """``bars`` with divisor and share_ratio: products over the actions strictly after a bar, of all structural kinds and of splits and bonuses."""
    use = applied(bars, actions, policy)
    kinds = F.when(F.col("action_type").isin(*VOLUME_KINDS), F.col("ratio"))
    per = use.groupBy("symbol", F.col("anchor").alias("date")).agg(F.product("ratio").alias("tl_p"), F.product(kinds).alias("tl_s"))
    if volume_policy is not None and volume_policy != policy:
        other = applied(bars, actions, volume_policy).groupBy("symbol", F.col("anchor").alias("date")).agg(F.product(kinds).alias("tl_s"))
        per = per.drop("tl_s").join(other, ["symbol", "date"], "full")
    df = bars.join(per, ["symbol", "date"], "left")
    return df.withColumn("divisor", product_after(F.coalesce("tl_p", F.lit(1.0)))).withColumn("share_ratio", product_after(F.coalesce("tl_s", F.lit(1.0)))).drop("tl_p", "tl_s")


def implied_dividends(bars: DataFrame, actions: DataFrame, least: float = 1e-4, most: float = 0.25) -> DataFrame:
    """symbol, date, cash: from steps of adj_close / close, where the yield is plausible and no structural action is within one bar."""
    f = F.col("adj_close") / nonzero(F.col("close"))
    near = applied(bars, actions, "always").select("symbol", F.col("anchor").alias("date")).distinct().withColumn("tl_x", F.lit(1))
    df = bars.withColumn("tl_f", f).join(near, ["symbol", "date"], "left")
    beside = F.max("tl_x").over(series().rowsBetween(-1, 1)).isNotNull()
    dividend_yield = 1 - F.lag("tl_f").over(series()) / nonzero(F.col("tl_f"))
    df = df.withColumn("tl_y", dividend_yield).withColumn("tl_n", beside).withColumn("cash", F.col("tl_y") * F.lag("close").over(series()))
    return df.where((F.col("tl_y") > least) & (F.col("tl_y") <= most) & ~F.col("tl_n")).select("symbol", "date", "cash")


def with_dividends(bars: DataFrame, actions: DataFrame, source: str = "actions") -> DataFrame:
    """Bars with ``divisor`` get dividend_raw and dividend: cash on the ex anchor, divided by the divisor of the bar before.

    ``source``: the table (actions), what prices imply (adjclose), or the table where a symbol has rows there (auto).
    """
    table = anchored(bars, actions.where("action_type = 'dividend' and dividend_amount > 0")).where("anchor is not null").groupBy("symbol", F.col("anchor").alias("date")).agg(F.sum("dividend_amount").alias("cash"))
    if source == "adjclose":
        cash = implied_dividends(bars, actions)
    elif source == "auto":
        has = actions.where("action_type = 'dividend'").select("symbol").distinct()
        cash = table.unionByName(implied_dividends(bars, actions).join(has, "symbol", "left_anti"))
    else:
        cash = table
    df = bars.join(cash.withColumnRenamed("cash", "dividend_raw"), ["symbol", "date"], "left").withColumn("dividend_raw", F.coalesce("dividend_raw", F.lit(0.0)))
    return df.withColumn("dividend", F.col("dividend_raw") / F.coalesce(F.lag("divisor").over(series()), F.col("divisor")))


def with_quality(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """approx_ratio, ambiguous, uncrossable, date_uncertain, segment_id, quality (';'-joined tokens).

    The first three hold for bars strictly before an action of the kind, the fourth within one bar of a derived date;
    a segment ends at each uncrossable action.
    """
    v = folded(bars, actions)

    def last(df: DataFrame, name: str) -> DataFrame:
        return anchored(bars, df.select("symbol", "ex_date").distinct()).groupBy("symbol").agg(F.max(F.coalesce("anchor", "ex_date")).alias(name))

    df = bars
    for name, of in (("tl_a", approximate(actions)), ("tl_m", v.where("verdict = 'AMBIGUOUS'")), ("tl_u", uncrossable(actions))):
        df = df.join(last(of, name), "symbol", "left")
    cuts = anchored(bars, uncrossable(actions).select("symbol", "ex_date").distinct()).where("anchor is not null").groupBy("symbol", F.col("anchor").alias("date")).agg(F.count(F.lit(1)).alias("tl_cut"))
    marks = anchored(bars, derived_dates(actions).select("symbol", "ex_date").distinct()).where("anchor is not null").select("symbol", F.col("anchor").alias("date")).distinct().withColumn("tl_d", F.lit(1))
    df = df.join(cuts, ["symbol", "date"], "left").join(marks, ["symbol", "date"], "left")
    before = lambda c: F.coalesce(F.col("date") < F.col(c), F.lit(False))
    flags = {"approx_ratio": before("tl_a"), "ambiguous": before("tl_m"), "uncrossable": before("tl_u"), "date_uncertain": F.max("tl_d").over(series().rowsBetween(-1, 1)).isNotNull()}
    df = df.withColumns(flags).withColumn("segment_id", F.sum(F.coalesce("tl_cut", F.lit(0))).over(so_far()))
    tokens = F.array(*[F.when(F.col(k), F.lit(k.upper())) for k in flags])
    return df.withColumn("quality", F.array_join(F.filter(tokens, lambda x: x.isNotNull()), ";")).drop("tl_a", "tl_m", "tl_u", "tl_cut", "tl_d")


def adjusted(bars: DataFrame, actions: DataFrame, policy: str = "auto", dividends: str = "actions", volume_policy: str | None = None) -> DataFrame:
    """The whole table: bars, divisors, adjusted prices and volume, dividends, action tags, quality."""
    df = with_divisors(bars, actions, policy, volume_policy)
    df = df.withColumns({f"adj_{c}": F.col(c) / F.col("divisor") for c in ("open", "high", "low", "close")} | {"adj_volume": F.col("volume") * F.col("share_ratio")})
    df = with_dividends(df, actions, dividends)
    tags = anchored(bars, actions.select("symbol", "ex_date", "action_type")).where("anchor is not null").groupBy("symbol", F.col("anchor").alias("date")).agg(F.array_join(F.array_sort(F.collect_set("action_type")), ";").alias("action_types"))
    return with_quality(df.join(tags, ["symbol", "date"], "left"), actions)


def residual_jumps(adj: DataFrame, actions: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Adjusted moves over the threshold on bars that are no ex-date's anchor."""
    df = adj.withColumn("move", F.col("adj_close") / nonzero(F.lag("adj_close").over(series())) - 1).where(F.abs("move") > threshold)
    exempt = anchored(adj, actions.where(F.col("action_type").isin(*STRUCTURAL)).select("symbol", "ex_date").distinct()).where("anchor is not null").select("symbol", F.col("anchor").alias("date")).distinct()
    return df.join(exempt, ["symbol", "date"], "left_anti").select("symbol", "date", "move")


def repaired(bars: DataFrame, artifacts: DataFrame, index: DataFrame) -> DataFrame:
    """Prices before an artifact (symbol, date) scaled so that its day has the index's return, or the return of a known holder (``as_return``).

    Each factor is a ratio of neighbouring prices that every other event scales alike, so one product over later events does.
    ``index``: date, level. Closes that are missing are passed over.
    """
    s = series()
    last = F.last("close", ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1))
    last_date = F.last(F.when(F.col("close").isNotNull(), F.col("date")), ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1))
    df = bars.withColumn("tl_b", last).withColumn("tl_bd", last_date).join(artifacts.withColumn("tl_e", F.lit(1)), ["symbol", "date"], "left")
    lev = index.select(F.col("date"), F.col("level").alias("tl_i1"))
    df = df.join(lev, "date", "left").join(index.select(F.col("date").alias("tl_bd"), F.col("level").alias("tl_i0")), "tl_bd", "left")
    wanted = 1 + (F.coalesce("as_return", F.col("tl_i1") / nonzero(F.col("tl_i0")) - 1) if "as_return" in artifacts.columns else F.col("tl_i1") / nonzero(F.col("tl_i0")) - 1)
    factor = F.when(F.col("tl_e").isNotNull(), F.col("close") / nonzero(F.col("tl_b")) / wanted)
    df = df.withColumn("tl_f", F.coalesce(factor, F.lit(1.0))).withColumn("tl_p", product_after(F.col("tl_f")))
    return df.select(*[(F.col(c) * F.col("tl_p")).alias(c) if c in ("open", "high", "low", "close") else F.col(c) for c in bars.columns])


def total_return_open(open_: Column, close: Column, adj_close: Column) -> Column:
    return open_ * (adj_close / nonzero(close))
