"""Window expressions over ordered series and over cross-sections."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalars import clip


def series(key: str | list[str], order: str = "date") -> WindowSpec:
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(value: Column, w: WindowSpec, n: int, *need: Column) -> Column:
    """value only where the last n rows all have the needed columns."""
    ok = need[0].isNotNull()
    for c in need[1:]:
        ok &= c.isNotNull()
    return F.when(F.sum(ok.cast("int")).over(trailing(w, n)) == n, value)


def simple_return(x: Column, w: WindowSpec, k: int = 1) -> Column:
    before = F.lag(x, k).over(w)
    return F.when(before != 0, x / before - 1)


def log_return(x: Column, w: WindowSpec, k: int = 1) -> Column:
    before = F.lag(x, k).over(w)
    return F.when((x > 0) & (before > 0), F.ln(x / before))


def forward_return(x: Column, w: WindowSpec, h: int) -> Column:
    """From the close of the next row to the close h rows on."""
    entry = F.lead(x, 1).over(w)
    return F.when(entry != 0, F.lead(x, h + 1).over(w) / entry - 1)


def running_product(gross: Column, w: WindowSpec) -> Column:
    """Cumulated product, nulls as 1: the exponential of summed logarithms of sizes, with the sign of the count of negative
    factors, and 0 from the first 0 on."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda hit: F.coalesce(F.sum(hit.cast("int")).over(upto), F.lit(0))
    size = F.exp(F.sum(F.when(gross != 0, F.ln(F.abs(gross))).otherwise(0.0)).over(upto))
    return F.when(count(gross == 0) > 0, 0.0).otherwise(F.when(count(gross < 0) % 2 == 1, -size).otherwise(size))


def rolling_z(x: Column, w: WindowSpec, n: int) -> Column:
    """(x - mean) / sd of the last n rows; 0 where sd is 0, null until the window is full."""
    sd = F.stddev_samp(x).over(trailing(w, n))
    z = F.when(sd > 0, (x - F.avg(x).over(trailing(w, n))) / sd).otherwise(0.0)
    return full(z, w, n, x)


def rolling_corr(x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    return full(F.corr(x, y).over(trailing(w, n)), w, n, x, y)


def rolling_beta(y: Column, x: Column, w: WindowSpec, n: int) -> Column:
    var = F.var_samp(x).over(trailing(w, n))
    return full(F.when(var > 0, F.covar_samp(y, x).over(trailing(w, n)) / var), w, n, x, y)


def rolling_sum(x: Column, w: WindowSpec, n: int) -> Column:
    return full(F.sum(x).over(trailing(w, n)), w, n, x)


def average_rank(x: Column, *by: str) -> Column:
    """Ascending rank with ties averaged; null stays null."""
    order = Window.partitionBy(*by, x.isNull()).orderBy(x)
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def zscore(x: Column, *by: str) -> Column:
    """Against the mean and sample sd of the group; 0 where the group has no sd; null stays null."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(x).over(w)
    return F.when(x.isNotNull(), F.when(sd > 0, (x - F.avg(x).over(w)) / sd).otherwise(0.0))


def winsorised(x: Column, *by: str, cut: float = 0.01) -> Column:
    """Clipped to the cut and 1 - cut linear quantiles of the group; groups under three values are untouched."""
    w = Window.partitionBy(*by)
    return F.when(F.count(x).over(w) >= 3, clip(x, F.percentile(x, F.lit(cut)).over(w), F.percentile(x, F.lit(1 - cut)).over(w))).otherwise(x)


def quantile_bucket(x: Column, n: int, *by: str, tie: str = "ticker") -> Column:
    """floor(ordinal rank * n / (N + 1)), within 0..n-1."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(x, tie))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.least(F.floor(rank * n / (size + 1)), F.lit(n - 1)).cast("int")


def drawdown(level: Column, w: WindowSpec) -> Column:
    """level over its running maximum, less 1."""
    return level / F.max(level).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
