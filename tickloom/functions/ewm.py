"""Exponentially weighted means as window sums.

y(i) = sum of a * w^(i-j) * x(j), w = 1 - a, over the non-null rows j <= i. A plain closed form divides
by w^j and overflows on long series. So rows are counted in blocks, short enough for the powers of one
block; a block adds what the block before it ended with, and what lies two blocks back has faded below
double precision. All windows need the rows of one key together, so there is one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Natural logarithm of the largest power within a block.
_REACH = 300.0


def ewm(df: DataFrame, x: Column, out: str, alpha: float, mode: str = "recursive", seed: int = 1, least: int = 1, keys: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """``df`` with column ``out``, the weighted mean of x so far; NULL before ``least`` values.

    mode ``recursive``: y(0) = x(0), then y = w * y + a * x. ``weighted``: the mean with weights w^age.
    ``seeded``: the mean of the first ``seed`` values stands at the last of them, then as recursive.
    On rows where x is NULL the last mean stays.
    """
    w = 1.0 - alpha
    block = max(2, int(_REACH / -math.log(w)))
    series = Window.partitionBy(*keys).orderBy(order)
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    first = seed if mode == "seeded" else 1
    power = lambda k: F.pow(F.lit(w), k.cast("double"))
    df = df.withColumn("tl_x", x.cast("double")).withColumn("tl_c", F.count("tl_x").over(so_far))
    here = F.col("tl_x").isNotNull()
    start = {"weighted": F.col("tl_x"), "recursive": F.col("tl_x") / alpha, "seeded": F.avg("tl_x").over(so_far) / alpha}[mode]
    df = df.withColumn("tl_v", F.when(here & (F.col("tl_c") == first), start).when(here & (F.col("tl_c") > first), F.col("tl_x")))
    df = df.withColumn("tl_i", (F.col("tl_c") - first).cast("long"))
    df = df.withColumn("tl_b", F.floor(F.col("tl_i") / block)).withColumn("tl_k", F.col("tl_i") - F.col("tl_b") * block)
    within = Window.partitionBy(*keys, "tl_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("tl_l", F.sum(F.col("tl_v") * power(-F.col("tl_k"))).over(within) * power(F.col("tl_k")))
    ended = F.last(F.when(here & (F.col("tl_k") == block - 1), F.col("tl_l")), ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("tl_e", ended)
    total = F.col("tl_l") + F.when(F.col("tl_b") > 0, F.coalesce("tl_e", F.lit(0.0)) * power(F.col("tl_k") + 1)).otherwise(F.lit(0.0))
    mean = total * alpha / (1 - power(F.col("tl_i") + 1)) if mode == "weighted" else alpha * total
    df = df.withColumn("tl_y", F.when(here & (F.col("tl_i") >= 0), mean))
    stays = F.last("tl_y", ignorenulls=True).over(so_far)
    df = df.withColumn(out, F.when(F.col("tl_c") >= max(least, first), stays))
    return df.drop("tl_x", "tl_c", "tl_v", "tl_i", "tl_b", "tl_k", "tl_l", "tl_e", "tl_y")
