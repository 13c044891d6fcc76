"""Window expressions over a bar panel. A frame without enough non-null values gives NULL; nulls are skipped."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> WindowSpec:
    """One symbol in order of time."""
    return Window.partitionBy("symbol").orderBy("date")


def past(n: int, spec: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, this one included."""
    return (spec or series()).rowsBetween(-(n - 1), 0)


def so_far(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or series()).rowsBetween(Window.unboundedPreceding, 0)


def over(agg: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    """The aggregate over the frame where that has at least ``least`` values of x."""
    return F.when(F.count(x).over(frame) >= least, agg.over(frame))


def rolling(fn, x: Column, n: int, least: int | None = None, spec: WindowSpec | None = None) -> Column:
    """fn (F.avg, F.stddev_samp, F.max ...) over the last n rows; ``least`` defaults to n."""
    return over(fn(x), x, past(n, spec), n if least is None else least)


def change(x: Column, n: int = 1, spec: WindowSpec | None = None) -> Column:
    """x over its value n rows ago, less 1."""
    return x / nonzero(F.lag(x, n).over(spec or series())) - 1


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def rolling_median(x: Column, n: int, least: int | None = None) -> Column:
    return over(F.percentile(x, F.lit(0.5)), x, past(n), n if least is None else least)


def rolling_skew(x: Column, n: int) -> Column:
    """With the bias correction; Spark's own skewness is that of the population."""
    return rolling(F.skewness, x, n) * (n * (n - 1)) ** 0.5 / (n - 2)


def rolling_beta(x: Column, of: Column, n: int, least: int | None = None) -> Column:
    """Covariance over variance of ``of``, where both are there."""
    both = F.when(x.isNotNull() & of.isNotNull(), x)
    other = F.when(x.isNotNull() & of.isNotNull(), of)
    frame = past(n)
    return F.when(F.count(both).over(frame) >= (n if least is None else least), F.covar_samp(both, other).over(frame) / nonzero(F.var_samp(other).over(frame)))


def rolling_rank(x: Column, n: int, least: int) -> Column:
    """Average rank of the row's value among the frame's, over their number."""
    values = F.collect_list(x).over(past(n))
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return F.when((F.size(values) >= least) & x.isNotNull(), (below + (equal + 1) / 2) / F.size(values))


def rolling_line(y: Column, n: int, i: Column) -> tuple[Column, Column]:
    """(slope, value) of the least-squares line through the n rows before this one, extrapolated to this row; ``i`` is a column with the row's number.

    Two sums a frame make the line, whatever its length.
    """
    frame = series().rowsBetween(-n, -1)
    total = F.sum(y).over(frame)
    mean_x = -(n + 1) / 2
    slope = F.when(F.count(y).over(frame) == n, (F.sum(y * i).over(frame) - (i + mean_x) * total) / (n * (n * n - 1) / 12))
    return slope, total / n - slope * mean_x


def zscore(x: Column, n: int, least: int | None = None) -> Column:
    return (x - rolling(F.avg, x, n, least)) / nonzero(rolling(F.stddev_samp, x, n, least))


def extreme_before(fn, x: Column, n: int, least: int | None = None) -> Column:
    """fn over the n rows before this one."""
    return over(fn(x), x, series().rowsBetween(-n, -1), n if least is None else least)


def extreme_after(fn, x: Column, n: int, least: int = 1) -> Column:
    """fn over the n rows after this one."""
    return over(fn(x), x, series().rowsBetween(1, n), least)


def is_pivot(x: Column, k: int, high: bool) -> Column:
    """Whether x is the extreme of the rows k before to k after, all of them there."""
    frame = series().rowsBetween(-k, k)
    most = F.max(x).over(frame) if high else F.min(x).over(frame)
    return F.coalesce((F.count(x).over(frame) == 2 * k + 1) & (x == most), F.lit(False))


def product_after(x: Column) -> Column:
    """The product of x over all rows strictly after this one; 1 without any. Read backwards it is a running product, in linear time."""
    return F.coalesce(F.product(x).over(Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))


def product_so_far(x: Column, spec: WindowSpec | None = None) -> Column:
    return F.product(x).over(so_far(spec))


def filled(x: Column, limit: int | None = None, spec: WindowSpec | None = None) -> Column:
    """The last value that is there, at most ``limit`` rows old."""
    return F.last(x, ignorenulls=True).over(so_far(spec) if limit is None else (spec or series()).rowsBetween(-limit, 0))


def section_rank(x: Column, keys: tuple[str, ...] = ("date",), descending: bool = False) -> Column:
    """Average rank among the rows of a key over the number of values: 1 is the largest, or the smallest with ``descending``."""
    group = Window.partitionBy(*keys)
    order = group.orderBy(x.isNull(), x.desc() if descending else x.asc())
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(x).over(group))


def section_zscore(x: Column, keys: tuple[str, ...] = ("date",)) -> Column:
    group = Window.partitionBy(*keys)
    return (x - F.avg(x).over(group)) / nonzero(F.stddev_samp(x).over(group))


def section_median(x: Column, keys: tuple[str, ...] = ("date",)) -> Column:
    return F.percentile(x, F.lit(0.5)).over(Window.partitionBy(*keys))


def run_id(same: Column, spec: WindowSpec | None = None) -> Column:
    """A running number that goes up where ``same`` is not true."""
    return F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(so_far(spec))


def every(k: int, offset: int = 0, spec: WindowSpec | None = None) -> Column:
    """True on each k-th row, the first of them after ``offset`` rows."""
    n = F.row_number().over(spec or series()) - 1
    return (n >= offset) & (F.pmod(n - offset, F.lit(k)) == 0)


def true_range() -> Column:
    """The first bar, without a close before it, has high - low."""
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
