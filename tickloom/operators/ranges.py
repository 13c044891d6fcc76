"""Range joins by buckets: points in intervals, and intervals that overlap.

A join on a key with the range as a filter compares every interval of a key with every point of it. Here the axis is cut into buckets of a given width:
an interval is dealt to each bucket it touches, a point to its own, and the join is an equality on key and bucket, with the range checked
after it. So work follows the intervals' length, not the key's rows, and one key's rows are spread over its buckets. A width near a usual
interval's length makes two buckets an interval; a much smaller one copies intervals, a much larger one compares more.

Dates, timestamps and numbers can be ranged over; ``width`` is in days, seconds or units. A missing end or point meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    if kind == "date":
        return F.unix_date(c).cast("long")
    return F.col(c).cast("double") if kind in ("timestamp", "double", "float", "decimal") else F.col(c).cast("long")


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def _dealt(intervals: DataFrame, start: str, stop: str, width: float) -> DataFrame:
    """``intervals`` once for each bucket it touches, tl_bucket; none where it ends before it begins."""
    lo, hi = _bucket(_number(intervals, start), width), _bucket(_number(intervals, stop), width)
    return intervals.where(F.col(start) <= F.col(stop)).withColumn("tl_bucket", F.explode(F.sequence(lo, hi)))


def within(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, width: float, how: str = "inner") -> DataFrame:
    """Points joined with the intervals of their keys that hold them, ends included, each pair once.

    ``how``: inner (columns of both, keys once), left (points without an interval too), left_semi (points in any interval) or left_anti (in none).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how!r}")
    names = {k: f"tl_key_{n}" for n, k in enumerate(keys)}
    dealt = _dealt(intervals, start, stop, width).withColumnsRenamed(names | {"tl_bucket": "tl_of"})
    rows = points.withColumn("tl_bucket", _bucket(_number(points, at), width))
    met = (F.col("tl_bucket") == F.col("tl_of")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop))
    for k, n in names.items():
        met = met & (F.col(k) == F.col(n))
    return rows.join(dealt, met, how).drop("tl_bucket", "tl_of", *names.values())


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], of_a: tuple[str, str], of_b: tuple[str, str], width: float) -> DataFrame:
    """Pairs of intervals of the same keys that share a point, each pair once: in the first bucket that both touch."""
    names = {k: f"tl_key_{n}" for n, k in enumerate(keys)}
    left, right = _dealt(a, *of_a, width), _dealt(b, *of_b, width).withColumnsRenamed(names | {"tl_bucket": "tl_of"})
    owner = F.greatest(_bucket(_number(a, of_a[0]), width), _bucket(_number(b, of_b[0]), width))
    met = (F.col("tl_bucket") == F.col("tl_of")) & (F.col(of_a[0]) <= F.col(of_b[1])) & (F.col(of_b[0]) <= F.col(of_a[1])) & (F.col("tl_bucket") == owner)
    for k, n in names.items():
        met = met & (F.col(k) == F.col(n))
    return left.join(right, met).drop("tl_bucket", "tl_of", *names.values())
