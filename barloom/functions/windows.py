"""Column helpers with the semantics of positional, null-skipping rolling windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

# One window specification for each key, so that Spark sorts once for all that share it. They are made when they are
# used: a specification needs a session, and importing a module should not.


def by_name() -> WindowSpec:
    """A name's bars in order."""
    return Window.partitionBy("ticker").orderBy("date")


def by_date() -> WindowSpec:
    """A date's names."""
    return Window.partitionBy("date")


def by_series() -> WindowSpec:
    """A series' values in order."""
    return Window.partitionBy("series").orderBy("date")


def all_dates() -> WindowSpec:
    """All dates in order: for frames of one row for each date."""
    return Window.partitionBy(F.lit(1)).orderBy("date")


def rolling(function: Callable[[Column], Column], x: Column, n: int, base: WindowSpec | None = None, frame_column: Column | None = None) -> Column:
    """function over the last n rows, null unless all n values are there."""
    w = (base or by_name()).rowsBetween(1 - n, 0)
    return F.when(F.count(x if frame_column is None else frame_column).over(w) == n, function(x).over(w))


def mean(x: Column, n: int, base: WindowSpec | None = None) -> Column:
    return rolling(F.avg, x, n, base)


def std(x: Column, n: int, base: WindowSpec | None = None) -> Column:
    return rolling(F.stddev_samp, x, n, base)


def skew(x: Column, n: int, base: WindowSpec | None = None) -> Column:
    """Bias-corrected skewness; Spark's own is that of the population."""
    return rolling(F.skewness, x, n, base) * (n * (n - 1)) ** 0.5 / (n - 2)


def kurt(x: Column, n: int, base: WindowSpec | None = None) -> Column:
    """Bias-corrected excess kurtosis."""
    return F.lit((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * rolling(F.kurtosis, x, n, base) + 6)


def clip(x: Column, low: float, high: float) -> Column:
    """x held to an interval; null stays null, which least and greatest alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def pct_rank(x: Column, over: WindowSpec | None = None, *keys: str) -> Column:
    """Rank from 1 / n to 1 with averaged ties among the values that are not null.

    A value's mean place among its ties comes from its ranks from both ends, so that the keys' partitioning is the only one.
    """
    part = Window.partitionBy(*keys) if over is None else over
    n = F.count(x).over(part)
    up, down = F.rank().over(part.orderBy(x.asc_nulls_last())), F.rank().over(part.orderBy(x.desc_nulls_last()))
    return F.when(x.isNotNull(), (up + n + 1 - down) / 2 / n)


def forward_fill(x: Column, base: WindowSpec | None = None) -> Column:
    return F.last(x, ignorenulls=True).over((base or by_name()).rowsBetween(Window.unboundedPreceding, 0))


def cumulative(function: Callable[[Column], Column], x: Column, base: WindowSpec) -> Column:
    return function(x).over(base.rowsBetween(Window.unboundedPreceding, 0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
