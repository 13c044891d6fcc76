"""Aggregates: scoring, rank correlation, bootstrap, clustering, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..functions.rolling import nonzero, section_rank


def ols(joined: DataFrame, y: str, x: str, keys: tuple[str, ...] = (), least: int = 100) -> DataFrame:
    """n, beta, alpha (a year of 252 days), t_alpha; NULL with fewer than ``least`` pairs."""
    both = joined.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    a = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("a0"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("mx")
    )
    n = F.col("n")
    s2 = (F.col("syy") - F.col("sxy") * F.col("sxy") / nonzero(F.col("sxx"))) / nonzero((n - 2).cast("double"))
    se = F.sqrt(s2 * (1 / n + F.col("mx") * F.col("mx") / nonzero(F.col("sxx"))))
    ok = n >= least
    return a.select(*keys, "n", F.when(ok, F.col("beta")).alias("beta"), F.when(ok, F.col("a0") * 252).alias("alpha"), F.when(ok, F.col("a0") / nonzero(se)).alias("t_alpha"))


def pearson(a: str, b: str) -> Column:
    """The correlation over rows that have both: NaN where a column is constant in them, NULL without such a row. (``corr`` divides by zero there, an error in ANSI mode.)"""
    spread = F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b))
    return F.when(F.regr_count(a, b) > 0, F.coalesce(F.try_divide(F.regr_sxy(a, b), spread), F.lit(float("nan"))))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, rho for each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[pearson(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("rho")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def correlation_clusters(rho: DataFrame, names: list[str], threshold: float = 0.6) -> DataFrame:
    """name, cluster (the first name's place): connected components of pairs over the threshold.

    A recursive query: each name's set takes in the other ends of the links that touch it, until it grows no more. The links are one row of at most a
    pair of columns each; a chain of over 99 links needs a higher ``spark.sql.cteRecursionLevelLimit``.
    """
    return rho.sparkSession.sql(
        """WITH RECURSIVE net AS (SELECT collect_list(struct(a, b)) AS links FROM {rho} WHERE abs(rho) > :threshold),
        walk(name, seen) AS (
          SELECT name, array(name) FROM (SELECT explode(:names) AS name)
          UNION ALL
          SELECT name, grown FROM (
            SELECT name, seen, array_distinct(concat(seen, transform(filter(links, x -> array_contains(seen, x.a)), x -> x.b), transform(filter(links, x -> array_contains(seen, x.b)), x -> x.a))) AS grown
            FROM walk JOIN net ON true)
          WHERE size(grown) > size(seen))
        SELECT name, CAST(array_min(transform(max_by(seen, size(seen)), x -> array_position(:names, x))) - 1 AS INT) AS cluster FROM walk GROUP BY name""",
        args={"threshold": threshold, "names": names}, rho=kept(rho),
    )


def cluster_keepers(clusters: DataFrame, rho: DataFrame, scores: DataFrame) -> DataFrame:
    """cluster, name, size, score, max_rho, keeper, scored: whom to keep of each cluster of columns.

    ``scores``: name, score (columns without one may be absent). The keeper has the greatest score, of equal ones the last name; ``scored`` tells
    whether it has one at all. ``max_rho`` is the greatest absolute correlation of any two of the cluster, linked or not; NULL for a single column.
    """
    lone = F.lit(float("-inf"))
    each = clusters.join(scores.select("name", "score"), "name", "left").withColumn("tl_s", F.coalesce("score", lone))
    best = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("tl_s", "name")).alias("best"))
    ends = rho.join(clusters.select(F.col("name").alias("a"), "cluster"), "a").join(clusters.select(F.col("name").alias("b"), F.col("cluster").alias("other")), "b")
    inside = ends.where("cluster = other").groupBy("cluster").agg(F.max(F.when(~F.isnan("rho"), F.abs("rho"))).alias("max_rho"))
    out = each.join(best, "cluster").join(inside, "cluster", "left")
    return out.select("cluster", "name", "size", "score", "max_rho", (F.col("name") == F.col("best.name")).alias("keeper"), (F.col("best.tl_s") > lone).alias("scored"))


def rank_ic(df: DataFrame, score: str, ret: str, step: int = 4) -> DataFrame:
    """offset, n, ic, t: the mean Spearman correlation by date; t over every ``step``-th date from each offset."""
    both = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    both = both.withColumn("tl_a", section_rank(F.col(score))).withColumn("tl_b", section_rank(F.col(ret)))
    daily = both.groupBy("date").agg(pearson("tl_a", "tl_b").alias("ic"), F.count(F.lit(1)).alias("k")).where("k >= 3 and ic is not null and not isnan(ic)")
    numbered = daily.withColumn("offset", (F.row_number().over(Window.orderBy("date")) - 1) % step)  # a row a date
    g = numbered.groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("sd"))
    return g.select("offset", "n", "ic", (F.col("ic") / nonzero(F.col("sd")) * F.sqrt("n")).alias("t"))


def hit_rate(df: DataFrame, score: str, ret: str, tail: float | None = None) -> DataFrame:
    """One row: n, rate at which the side of the score's median and that of the return's agree, over the outer ``tail`` of scores if given."""
    both = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    rank = section_rank(F.col(score))
    med = lambda c: F.percentile(c, F.lit(0.5)).over(Window.partitionBy("date"))
    both = both.withColumn("tl_k", rank).withColumn("tl_s", F.col(score) > med(score)).withColumn("tl_r", F.col(ret) > med(ret))
    if tail is not None:
        both = both.where((F.col("tl_k") <= tail) | (F.col("tl_k") > 1 - tail))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("tl_s") == F.col("tl_r")).cast("double")).alias("rate"))


def nonoverlap_t(daily: DataFrame, value: str, h: int, least: int = 11) -> DataFrame:
    """One row: mean and t over every h-th day, averaged over all offsets with enough days."""
    n = (F.row_number().over(Window.orderBy("date")) - 1) % h
    g = daily.where(F.col(value).isNotNull()).withColumn("o", n).groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).where(F.col("n") >= least)
    return g.agg(F.avg("m").alias("mean"), F.avg(F.col("m") / nonzero(F.col("s")) * F.sqrt("n")).alias("t"))


def lift(df: DataFrame, keys: list[str], won: str, base: Column) -> DataFrame:
    """keys, cases, worked, base, lift, z: the share that worked, against a base rate, with the binomial z."""
    g = df.groupBy(*keys).agg(F.count(won).alias("cases"), F.avg(F.col(won).cast("double")).alias("worked"), F.max(base).alias("base"))
    return g.withColumn("lift", F.col("worked") - F.col("base")).withColumn("z", F.col("lift") / nonzero(F.sqrt(F.col("base") * (1 - F.col("base")) / nonzero(F.col("cases").cast("double")))))


def bootstrap(daily: DataFrame, value: str, block: int = 21, draws: int = 400, seed: int = 0, statistic: str = "mean", level: float = 0.90, circular: bool = True) -> DataFrame:
    """One row: n, estimate, low, high of the mean or the Sharpe ratio of a series with one row a date.

    Starts of blocks are drawn by a seeded hash of the draw and the block; draws meet the series by place. The series, a row a date, is computed once
    and is the side that is broadcast: draws are ``draws`` times as many.
    """
    s = kept(daily.where(F.col(value).isNotNull()).select(value, (F.row_number().over(Window.orderBy("date")) - 1).alias("i")))
    n = s.count()
    spark = daily.sparkSession
    if n == 0:
        return spark.createDataFrame([], "n long, estimate double, low double, high double")
    k, most = -(-n // block), n if circular else max(1, n - block + 1)
    rows = spark.range(draws * k).select(F.expr(f"id div {k}").alias("b"), F.expr(f"id % {k}").alias("j"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(most)).alias("s"))
    places = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("j") * block + F.col("o") < n).select("b", ((F.col("s") + F.col("o")) % n).alias("i"))
    x = F.col(value)
    stat = F.avg(x) if statistic == "mean" else F.avg(x) / nonzero(F.stddev_samp(x)) * 252**0.5
    per = places.join(F.broadcast(s), "i").groupBy("b").agg(stat.alias("v"))
    ends = per.agg(F.percentile("v", F.lit((1 - level) / 2)).alias("low"), F.percentile("v", F.lit((1 + level) / 2)).alias("high"))
    return s.agg(F.count(F.lit(1)).alias("n"), stat.alias("estimate")).crossJoin(ends)  # two rows of one


def paired_difference(a: DataFrame, b: DataFrame, value: str = "ret", **parameters) -> DataFrame:
    """The bootstrap of a - b over their common dates."""
    both = a.select("date", F.col(value).alias("x")).join(b.select("date", F.col(value).alias("y")), "date").withColumn("d", F.col("x") - F.col("y"))
    return bootstrap(both, "d", **parameters)


def confusion_metrics(pred: DataFrame, truth: str, guess: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, accuracy, macro_f1 (a class without hits counts 0), majority (the largest class's share)."""
    cells = pred.groupBy(*keys, truth, guess).agg(F.count(F.lit(1)).alias("n"))
    t = cells.groupBy(*keys, F.col(truth).alias("c")).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hits"))
    g = cells.groupBy(*keys, F.col(guess).alias("c")).agg(F.sum("n").alias("said"))
    df = t.join(g, [*keys, "c"], "full").na.fill(0, ["rows", "hits", "said"])
    f1 = F.coalesce(2 * F.col("hits") / nonzero((F.col("rows") + F.col("said")).cast("double")), F.lit(0.0))
    return df.groupBy(*keys).agg(F.sum("rows").alias("n"), (F.sum("hits") / F.sum("rows")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.max("rows") / F.sum("rows")).alias("majority"))


def log_loss_of(truth: str, probabilities: dict, eps: float = 1e-9) -> Column:
    """The mean of -ln of the true class's probability, clipped. ``probabilities``: the column of each class."""
    p = F.coalesce(*[F.when(F.col(truth) == c, F.col(col)) for c, col in probabilities.items()])
    return F.avg(-F.log(F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))))


def calibration_error(pred: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: the mean gap of confidence and accuracy over equal bins, the first one closed, weighted by rows."""
    b = F.greatest(F.ceil(F.col(confidence) * bins), F.lit(1))
    g = pred.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return g.agg((F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")) / F.sum("n")).alias("ece"))


def stock_years(run: DataFrame, hold: DataFrame, ret: str = "net_ret") -> DataFrame:
    """symbol, year, strat, hold, won: yearly products of returns, against holding."""
    y = lambda df, name: df.groupBy("symbol", F.year("date").alias("year")).agg((F.product(1 + F.col(ret)) - 1).alias(name))
    return y(run, "strat").join(y(hold, "hold"), ["symbol", "year"]).withColumn("won", F.col("strat") > F.col("hold"))


def month_ends(curve: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The last value of each month, on the month's last day."""
    g = curve.groupBy(*keys, F.trunc("date", "MM").alias("m")).agg(F.max_by(value, "date").alias(value))
    return g.select(*keys, F.last_day("m").alias("date"), value)


def period_stats(periods: DataFrame, value: str, per_year: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """cagr, vol, sharpe, max_dd of returns a period, in the order of ``i``."""
    s = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = periods.withColumn("tl_q", F.product(1 + F.col(value)).over(s)).withColumn("tl_d", F.col("tl_q") / F.greatest(F.max("tl_q").over(s), F.lit(1.0)) - 1)
    n = F.count(value)
    return df.groupBy(*keys).agg(
        n.alias("n"), (F.pow(F.max_by("tl_q", "i"), per_year / n) - 1).alias("cagr"), (F.stddev_samp(value) * per_year**0.5).alias("vol"), (F.avg(value) / nonzero(F.stddev_samp(value)) * per_year**0.5).alias("sharpe"), F.min("tl_d").alias("max_dd")
    )


def survivorship(panel: DataFrame, score: str, rank: str) -> DataFrame:
    """symbol, top_share (of dates in the top fifth), first_rank, last_rank, multiple (last over first close)."""
    df = panel.withColumn("tl_k", section_rank(F.col(score)))
    there = F.when(F.col(rank).isNotNull(), F.col("date"))
    return df.groupBy("symbol").agg(
        F.avg((F.col("tl_k") > 0.8).cast("double")).alias("top_share"), F.min_by(rank, there).alias("first_rank"), F.max_by(rank, there).alias("last_rank"), (F.max_by("close", "date") / F.min_by("close", "date")).alias("multiple")
    )


def label_scores(signals: DataFrame, labels: DataFrame, signal: str = "signal", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, n, precision (Up among signals), recall, base (Up among all), weight: signals at a bar against the bar's label."""
    rows = signals.join(labels.where("dropped_reason is null").select("symbol", "date", "label"), ["symbol", "date"])
    on, up = (F.col(signal) == 1).cast("double"), (F.col("label") == "Up").cast("double")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(on * up) / nonzero(F.sum(on))).alias("precision"), (F.sum(on * up) / nonzero(F.sum(up))).alias("recall"), F.avg(up).alias("base")
    )


def pooled_rate(scores: DataFrame, rate: str, n: str) -> DataFrame:
    """One row: the rate over all rows, weighted by their numbers."""
    return scores.where(F.col(rate).isNotNull()).agg((F.sum(F.col(rate) * F.col(n)) / nonzero(F.sum(n).cast("double"))).alias("rate"), F.sum(n).alias("n"))
